"""Document queries: filters, projections, groups, sorts, expressions, updates and searches by place."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.find import aggregate, count, distinct, find
from tessera.operators.updates import delete, insert, update
from tessera.sample import ITEM_DOCS, ORDER_DOCS, PLACE_DOCS, item_docs, order_docs, place_docs, table

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]
QUERIES: dict[str, Query] = {}


def of(name: str, source: Callable[[SparkSession, str], DataFrame] | str, run: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    make = source if callable(source) else (lambda s, d: table(s, d, source))
    QUERIES[name] = (lambda s, d: run(make(s, d)), sql)


def piped(name: str, source: Callable | str, pipeline: str, sql: str | None, wide: bool = False) -> None:
    of(name, source, lambda df: aggregate(df, pipeline, wide), sql)


ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def matched(name: str, filter: str, where: str) -> None:
    """A filter over orders, and the same condition in SQL."""
    of(name, "orders", lambda df: find(df, filter), f"select {ORDERS} from orders where {where}")


# ---- filters

matched("match_eq", '{"o_orderstatus": "F"}', "o_orderstatus = 'F'")
matched("match_ne", '{"o_orderstatus": {"$ne": "F"}}', "o_orderstatus is distinct from 'F'")
matched("match_range", '{"o_totalprice": {"$gte": 50000, "$lt": 150000.5}, "o_orderdate": {"$gt": {"$date": "1996-01-01T00:00:00Z"}}}', "o_totalprice >= 50000 and o_totalprice < 150000.5 and o_orderdate > timestamp '1996-01-01'")
matched("match_in", '{"o_orderpriority": {"$in": ["1-URGENT", "5-LOW", null]}}', "o_orderpriority in ('1-URGENT', '5-LOW') or o_orderpriority is null")
matched("match_nin", '{"o_orderpriority": {"$nin": ["1-URGENT", {"$regularExpression": {"pattern": "^[23]", "options": ""}}]}}', "not coalesce(o_orderpriority = '1-URGENT' or regexp_matches(o_orderpriority, '^[23]'), false)")
matched("match_and", '{"$and": [{"o_orderstatus": "O"}, {"o_custkey": {"$lte": 100}}]}', "o_orderstatus = 'O' and o_custkey <= 100")
matched("match_or", '{"$or": [{"o_totalprice": {"$gt": 300000}}, {"o_orderpriority": "5-LOW"}]}', "o_totalprice > 300000 or o_orderpriority = '5-LOW'")
matched("match_nor", '{"$nor": [{"o_totalprice": {"$gt": 100000}}, {"o_orderstatus": "F"}]}', "not (coalesce(o_totalprice > 100000, false) or coalesce(o_orderstatus = 'F', false))")
matched("match_not", '{"o_totalprice": {"$not": {"$lt": 200000}}}', "not coalesce(o_totalprice < 200000, false)")
matched("match_comment", '{"$comment": "all small orders", "o_totalprice": {"$lt": 30000}, "$alwaysTrue": 1}', "o_totalprice < 30000")
of("match_exists", order_docs, lambda df: find(df, '{"opt": {"$exists": true}}', projection='{"opt": 1}'), f"select _id, opt from {ORDER_DOCS} where opt is not null")
of("match_null", order_docs, lambda df: find(df, '{"opt": null, "nowhere": {"$exists": false}}', projection='{"cust": 1}'), f"select _id, cust from {ORDER_DOCS} where opt is null")
of("match_type", order_docs, lambda df: find(df, '{"tags": {"$type": "array"}, "total": {"$type": ["number", "string"]}}', projection='{"total": 1}'), f"select _id, total from {ORDER_DOCS} where tags is not null")
of("match_mod", "lineitem", lambda df: find(df, '{"l_quantity": {"$mod": [7, 3]}}', projection='{"l_orderkey": 1, "l_linenumber": 1, "l_quantity": 1}'), "select l_orderkey, l_linenumber, l_quantity from lineitem where cast(trunc(l_quantity) as bigint) % 7 = 3")
of("match_regex_prefix", "part", lambda df: find(df, '{"p_brand": {"$regex": "^Brand#[1-2]"}}'), "select * from part where regexp_matches(p_brand, '^Brand#[1-2]')")
of("match_regex_options", "part", lambda df: find(df, '{"p_type": {"$regex": "^(standard|promo)", "$options": "i"}}'), "select * from part where regexp_matches(p_type, '(?i)^(standard|promo)')")
of("match_array_any", order_docs, lambda df: find(df, '{"tags": "t1"}', projection='{"tags": 1}'), f"select _id, tags from {ORDER_DOCS} where coalesce(list_contains(tags, 't1'), false)")
of("match_array_ne", order_docs, lambda df: find(df, '{"tags": {"$ne": "t1"}}', projection='{"status": 1}'), f"select _id, status from {ORDER_DOCS} where not coalesce(list_contains(tags, 't1'), false)")
of("match_array_whole", order_docs, lambda df: find(df, '{"tags": ["t2", "t3"]}', projection='{"tags": 1}'), f"select _id, tags from {ORDER_DOCS} where tags = ['t2', 't3']")
of("match_all", order_docs, lambda df: find(df, '{"tags": {"$all": ["t1", "t2"]}}', projection='{"tags": 1}'), f"select _id, tags from {ORDER_DOCS} where coalesce(list_has_all(tags, ['t1', 't2']), false)")
of("match_size", order_docs, lambda df: find(df, '{"tags": {"$size": 0}}', projection='{"sub.x": 1}'), f"select _id, {{'x': sub.x}} as sub from {ORDER_DOCS} where len(tags) = 0")
of("match_position", order_docs, lambda df: find(df, '{"tags.1": "t3"}', projection='{"tags": 1}'), f"select _id, tags from {ORDER_DOCS} where tags[2] = 't3'")
of("match_nested", order_docs, lambda df: find(df, '{"sub.x": 2, "sub.y": {"$in": ["y0", "y1"]}}', projection='{"sub": 1}'), f"select _id, sub from {ORDER_DOCS} where sub.x = 2 and sub.y in ('y0', 'y1')")
of("match_object", order_docs, lambda df: find(df, '{"sub": {"x": 1, "y": "y1"}}', projection='{"total": 1}'), f"select _id, total from {ORDER_DOCS} where sub.x = 1 and sub.y = 'y1'")
of("match_witnesses", item_docs, lambda df: find(df, '{"items.qty": {"$gt": 45, "$lt": 5}}', projection='{"_id": 1}'), f"select _id from {ITEM_DOCS} where len(list_filter(items, lambda i: i.qty > 45)) > 0 and len(list_filter(items, lambda i: i.qty < 5)) > 0")
of("match_elem_match", item_docs, lambda df: find(df, '{"items": {"$elemMatch": {"qty": {"$gt": 40}, "flag": "R"}}}', projection='{"_id": 1}'), f"select _id from {ITEM_DOCS} where len(list_filter(items, lambda i: i.qty > 40 and i.flag = 'R')) > 0")
of("match_elem_value", order_docs, lambda df: find(df, '{"tags": {"$elemMatch": {"$gte": "t1", "$lt": "t3"}}}', projection='{"tags": 1}'), f"select _id, tags from {ORDER_DOCS} where len(list_filter(tags, lambda t: t >= 't1' and t < 't3')) > 0")

# ---- projections and fields

of("project_include", "orders", lambda df: find(df, "{}", projection='{"o_orderkey": 1, "o_totalprice": 1}'), "select o_orderkey, o_totalprice from orders")
of("project_exclude", "orders", lambda df: find(df, "{}", projection='{"o_totalprice": 0, "o_orderdate": 0}'), "select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
of("project_nested", item_docs, lambda df: find(df, "{}", projection='{"items.qty": 1, "items.flag": 1}'), f"select _id, list_transform(items, lambda i: {{'qty': i.qty, 'flag': i.flag}}) as items from {ITEM_DOCS}")
piped("project_computed", order_docs, '[{"$project": {"_id": 0, "status": 1, "half": {"$divide": ["$total", 2]}, "where": {"a": "$sub.x", "b": {"$literal": "$x"}}}}]', f"select status, total / 2 as half, {{'a': sub.x, 'b': '$x'}} as \"where\" from {ORDER_DOCS}")
piped("project_remove", order_docs, '[{"$project": {"total": 1, "opt": "$$REMOVE", "all": "$$ROOT.sub.y"}}]', f"select _id, total, sub.y as all from {ORDER_DOCS}")
piped("add_fields", order_docs, '[{"$addFields": {"sub.z": {"$add": ["$sub.x", 1]}, "net": {"$multiply": ["$total", 0.9]}}}, {"$project": {"sub": 1, "net": 1}}]', f"select _id, {{'x': sub.x, 'y': sub.y, 'z': sub.x + 1}} as sub, total * 0.9::double as net from {ORDER_DOCS}")
piped("unset", order_docs, '[{"$unset": ["sub.x", "tags", "date", "opt", "priority"]}]', f"select _id, cust, status, total, {{'y': sub.y}} as sub from {ORDER_DOCS}")
piped("nested_set_in_array", item_docs, '[{"$set": {"items.seen": true}}, {"$unset": ["items.part", "items.flag"]}]', f"select _id, list_transform(items, lambda i: {{'line': i.line, 'qty': i.qty, 'seen': true}}) as items from {ITEM_DOCS}")
piped("array_path_map", item_docs, '[{"$project": {"quantities": "$items.qty"}}]', f"select _id, list_transform(items, lambda i: i.qty) as quantities from {ITEM_DOCS}")

# ---- groups

piped("group_sum", "lineitem", '[{"$group": {"_id": "$l_returnflag", "lines": {"$sum": "$l_linenumber"}, "ones": {"$sum": 1}, "none": {"$sum": "$l_linestatus"}}}]', "select l_returnflag as _id, cast(sum(l_linenumber) as bigint) as lines, count(*) as ones, 0::bigint as none from lineitem group by 1")
piped("group_avg", "lineitem", '[{"$group": {"_id": "$l_linestatus", "a": {"$avg": "$l_quantity"}, "none": {"$avg": "$l_returnflag"}}}]', "select l_linestatus as _id, avg(l_quantity) as a, null::double as none from lineitem group by 1")
piped("group_count", "lineitem", '[{"$group": {"_id": "$l_linenumber", "n": {"$count": {}}}}]', "select l_linenumber as _id, count(*) as n from lineitem group by 1")
piped("group_min", "lineitem", '[{"$group": {"_id": "$l_suppkey", "least": {"$min": "$l_extendedprice"}, "first": {"$min": "$l_shipdate"}}}]', "select l_suppkey as _id, min(l_extendedprice) as least, min(l_shipdate) as first from lineitem group by 1")
piped("group_max", "lineitem", '[{"$group": {"_id": "$l_suppkey", "most": {"$max": "$l_extendedprice"}, "flag": {"$max": "$l_returnflag"}}}]', "select l_suppkey as _id, max(l_extendedprice) as most, max(l_returnflag) as flag from lineitem group by 1")
piped("group_null_id", "orders", '[{"$group": {"_id": null, "n": {"$count": {}}, "most": {"$max": "$o_totalprice"}}}]', "select null::varchar as _id, count(*) as n, max(o_totalprice) as most from orders having count(*) > 0")
piped("group_null_id_empty", "orders", '[{"$match": {"o_orderkey": {"$lt": 0}}}, {"$group": {"_id": null, "n": {"$count": {}}}}]', "select null::varchar as _id, count(*) as n from orders where o_orderkey < 0 having count(*) > 0")
piped("group_object_id", "lineitem", '[{"$match": {"l_shipdate": {"$lte": {"$date": "1998-09-02T00:00:00Z"}}}}, {"$group": {"_id": {"f": "$l_returnflag", "s": "$l_linestatus"}, "n": {"$count": {}}, "most": {"$max": "$l_quantity"}}}, {"$sort": {"_id": 1}}]', "select {'f': l_returnflag, 's': l_linestatus} as _id, count(*) as n, max(l_quantity) as most from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus")
piped("group_missing_key", order_docs, '[{"$group": {"_id": "$opt", "n": {"$count": {}}}}]', f"select opt as _id, count(*) as n from {ORDER_DOCS} group by 1")
piped("group_first", order_docs, '[{"$group": {"_id": "$cust", "total": {"$first": "$total"}, "opt": {"$first": "$opt"}}}]', f"select cust as _id, arg_min_null(total, _id) as total, arg_min_null(opt, _id) as opt from {ORDER_DOCS} group by 1")
piped("group_last", order_docs, '[{"$sort": {"total": 1}}, {"$group": {"_id": "$priority", "order": {"$last": "$_id"}}}]', f"select priority as _id, arg_max(_id, (total, _id)) as \"order\" from {ORDER_DOCS} group by 1")
piped("group_first_mixed", order_docs, '[{"$sort": {"status": -1, "total": 1}}, {"$group": {"_id": "$cust", "order": {"$first": "$_id"}}}]', f"select cust as _id, list(_id order by status desc, total, _id)[1] as \"order\" from {ORDER_DOCS} group by 1")
piped("group_push", order_docs, '[{"$group": {"_id": "$cust", "orders": {"$push": "$_id"}, "opts": {"$push": "$opt"}}}]', f"select cust as _id, list(_id order by _id) as orders, coalesce(list(opt order by _id) filter (where opt is not null), []::varchar[]) as opts from {ORDER_DOCS} group by 1")
piped("group_push_sorted", order_docs, '[{"$sort": {"date": -1}}, {"$group": {"_id": "$status", "days": {"$push": "$_id"}}}]', f"select status as _id, list(_id order by date desc, _id) as days from {ORDER_DOCS} group by 1")
piped("group_add_to_set", order_docs, '[{"$group": {"_id": "$cust", "p": {"$addToSet": "$priority"}}}]', f"select cust as _id, list(priority order by f) as p from (select cust, priority, min(_id) as f from {ORDER_DOCS} group by 1, 2) group by 1")
piped("group_wide_sum", order_docs, '[{"$group": {"_id": "$status", "s": {"$sum": {"$multiply": ["$cust", {"$numberLong": "9000000000000000"}]}}}}, {"$project": {"big": {"$gt": ["$s", 9.3e18]}}}]', f"select status as _id, sum(cust * 9000000000000000.0::double) > 9.3e18 as big from {ORDER_DOCS} group by 1", wide=True)

# ---- order, limits, unwinding, counting

piped("sort_multi", "orders", '[{"$sort": {"o_orderpriority": 1, "o_totalprice": -1}}, {"$limit": 50}, {"$project": {"o_orderkey": 1, "o_totalprice": 1, "o_orderpriority": 1}}]', "select o_orderkey, o_totalprice, o_orderpriority from orders order by o_orderpriority, o_totalprice desc limit 50")
piped("top_k", "orders", '[{"$sort": {"o_totalprice": -1}}, {"$limit": 20}]', "select * from orders order by o_totalprice desc limit 20")
piped("skip_limit", order_docs, '[{"$sort": {"cust": 1}}, {"$skip": 5}, {"$skip": 6}, {"$limit": 40}, {"$limit": 30}, {"$project": {"cust": 1}}]', f"select _id, cust from {ORDER_DOCS} order by cust, _id limit 30 offset 11")
piped("limit_by_id", order_docs, '[{"$limit": 10}, {"$project": {"total": 1}}]', f"select _id, total from {ORDER_DOCS} order by _id limit 10")
piped("sort_array", item_docs, '[{"$sort": {"items.qty": -1, "_id": 1}}, {"$limit": 25}, {"$project": {"_id": 1}}]', f"select _id from {ITEM_DOCS} order by list_max(list_transform(items, lambda i: i.qty)) desc, _id limit 25")
of("find_sort_limit_project", order_docs, lambda df: find(df, '{"status": "O"}', '{"total": -1}', 3, 12, '{"total": 1, "sub.y": 1}'), f"select _id, total, {{'y': sub.y}} as sub from {ORDER_DOCS} where status = 'O' order by total desc, _id limit 12 offset 3")
piped("unwind", order_docs, '[{"$unwind": "$tags"}, {"$project": {"tags": 1}}]', f"select _id, unnest(tags) as tags from {ORDER_DOCS}")
piped("unwind_index", item_docs, '[{"$unwind": {"path": "$items", "includeArrayIndex": "at"}}, {"$project": {"at": 1, "line": "$items.line"}}]', f"select _id, cast(i - 1 as bigint) as at, items[i].line as line from (select _id, items, unnest(range(1, len(items) + 1)) as i from {ITEM_DOCS})")
piped("unwind_preserve", order_docs, '[{"$unwind": {"path": "$tags", "includeArrayIndex": "at", "preserveNullAndEmptyArrays": true}}, {"$project": {"tags": 1, "at": 1}}]', f"select _id, tags[i] as tags, cast(i - 1 as bigint) as at from (select _id, tags, unnest(range(1, len(tags) + 1)) as i from {ORDER_DOCS}) union all select _id, null, null from {ORDER_DOCS} where coalesce(len(tags), 0) = 0")
piped("unwind_group", order_docs, '[{"$unwind": "$tags"}, {"$group": {"_id": "$tags", "n": {"$count": {}}, "most": {"$max": "$total"}}}, {"$sort": {"n": -1}}]', f"select tags as _id, count(*) as n, max(total) as most from (select unnest(tags) as tags, total from {ORDER_DOCS}) group by 1")
piped("unwind_scalar", order_docs, '[{"$unwind": "$opt"}, {"$project": {"opt": 1}}]', f"select _id, opt from {ORDER_DOCS} where opt is not null")
piped("count_stage", "orders", '[{"$match": {"o_orderstatus": "P"}}, {"$count": "n"}]', "select count(*) as n from orders where o_orderstatus = 'P' having count(*) > 0")
piped("count_stage_empty", "orders", '[{"$match": {"o_orderstatus": "none"}}, {"$count": "n"}]', "select count(*) as n from orders where o_orderstatus = 'none' having count(*) > 0")
of("count_command", "orders", lambda df: count(df, '{"o_custkey": {"$gt": 500}}'), "select count(*) as n from orders where o_custkey > 500")
of("distinct_scalar", "orders", lambda df: distinct(df, "o_orderpriority"), "select distinct o_orderpriority as value from orders")
of("distinct_array", order_docs, lambda df: distinct(df, "tags", '{"status": "F"}'), f"select distinct unnest(tags) as value from {ORDER_DOCS} where status = 'F'")
of("distinct_nested", item_docs, lambda df: distinct(df, "items.flag"), f"select distinct i.flag as value from (select unnest(items) as i from {ITEM_DOCS})")
piped("match_after_group", "orders", '[{"$group": {"_id": "$o_custkey", "n": {"$count": {}}}}, {"$match": {"n": {"$gte": 12}}}, {"$sort": {"n": -1, "_id": 1}}]', "select o_custkey as _id, count(*) as n from orders group by 1 having count(*) >= 12")

# ---- expressions


def expression(name: str, spec: str, sql: str, source: Callable | str = order_docs, frm: str = ORDER_DOCS) -> None:
    piped(f"expr_{name}", source, '[{"$project": {"v": ' + spec + "}}]", f"select _id, {sql} as v from {frm}")


expression("arith", '{"$add": [{"$multiply": ["$cust", 3]}, {"$subtract": ["$sub.x", 10]}, 1]}', "cust * 3 + (sub.x - 10) + 1")
expression("divide", '{"$divide": ["$total", {"$add": ["$sub.x", 1]}]}', "total / (sub.x + 1)")
expression("mod", '{"$mod": [{"$subtract": ["$cust", 700]}, 7]}', "(cust - 700) % 7")
expression("mod_double", '{"$mod": ["$total", 1000.5]}', "total % 1000.5::double")
expression("cmp", '[{"$gt": ["$total", 100000]}, {"$eq": ["$opt", null]}, {"$lt": ["$opt", null]}, {"$gte": ["$opt", "o1"]}, {"$lt": ["$cust", "text"]}]', "[total > 100000, false, opt is null, coalesce(opt >= 'o1', false), true]")
expression("bool", '{"$or": [{"$and": ["$opt", {"$not": ["$sub.x"]}]}, {"$and": ["$nowhere", true]}]}', "opt is not null and sub.x = 0")
expression("cond", '{"$cond": {"if": {"$gte": ["$total", 150000]}, "then": "big", "else": {"$cond": [{"$lt": ["$total", 50000]}, "small", "$status"]}}}', "case when total >= 150000 then 'big' when total < 50000 then 'small' else status end")
expression("if_null", '{"$ifNull": ["$opt", "$nowhere", "$sub.y"]}', "coalesce(opt, sub.y)")
expression("concat", '{"$concat": ["$status", "-", "$opt"]}', "status || '-' || opt")
expression("case", '[{"$toLower": "$priority"}, {"$toUpper": "$sub.y"}, {"$toUpper": "$opt"}, {"$toLower": "$cust"}]', "[lower(priority), upper(sub.y), coalesce(upper(opt), ''), cast(cust as varchar)]")
expression("date_parts", '[{"$year": "$date"}, {"$month": "$date"}, {"$dayOfMonth": {"date": "$date", "timezone": "+02:00"}}]', "[cast(year(date) as integer), cast(month(date) as integer), cast(day(date + interval 2 hour) as integer)]")
expression("date_arith", '{"$subtract": [{"$add": ["$date", 86400000]}, "$date"]}', "86400000::bigint")
expression("size", '{"$size": "$items.qty"}', "len(items)", item_docs, ITEM_DOCS)
expression("object", '{"$ifNull": [{"a": "$sub.y", "b": ["$cust", 1]}, null]}', "{'a': sub.y, 'b': [cust, 1::bigint]}")

# ---- searches by place

HAVERSINE = "2 * 6378100.0 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians({lat})) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin((radians(lon) - radians({lon})) / 2), 2))))"
of("geo_near_topk", place_docs, lambda df: find(df, '{"loc": {"$near": {"$geometry": {"type": "Point", "coordinates": [13.4, 38.1]}, "$minDistance": 1000}}}', limit=10, projection='{"name": 1}'), f"select _id, name from {PLACE_DOCS} where {HAVERSINE.format(lon=13.4, lat=38.1)} >= 1000 order by {HAVERSINE.format(lon=13.4, lat=38.1)}, _id limit 10")
of("geo_radius", place_docs, lambda df: find(df, '{"loc": {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [179.5, 10]}, "$maxDistance": 2500000}}}', projection='{"name": 1}'), f"select _id, name from {PLACE_DOCS} where {HAVERSINE.format(lon=179.5, lat=10)} <= 2500000")
piped("geo_near_stage", place_docs, '[{"$geoNear": {"near": {"type": "Point", "coordinates": [0, 0]}, "distanceField": "far.m", "maxDistance": 4000000, "query": {"segment": "BUILDING"}, "distanceMultiplier": 0.001}}, {"$limit": 15}, {"$project": {"km": "$far.m"}}]', f"select _id, {HAVERSINE.format(lon=0, lat=0)} * 0.001 as km from {PLACE_DOCS} where segment = 'BUILDING' and {HAVERSINE.format(lon=0, lat=0)} <= 4000000 order by {HAVERSINE.format(lon=0, lat=0)}, _id limit 15")
of("geo_center_sphere", place_docs, lambda df: find(df, '{"loc": {"$geoWithin": {"$centerSphere": [[10, 80], 0.3]}}}', projection='{"name": 1}'), f"select _id, name from {PLACE_DOCS} where {HAVERSINE.format(lon=10, lat=80)} / 6378100.0 <= 0.3")

# ---- dynamic fields

of("json_path_group", "events", lambda df: aggregate(df.withColumn("k", F.expr("variant_get(parse_json(props), '$.k', 'bigint')")), '[{"$group": {"_id": "$k", "n": {"$count": {}}}}]'), "select cast(props->>'$.k' as bigint) as _id, count(*) as n from events group by 1")

# ---- updates


def updated(name: str, source: Callable | str, filter: str, spec: str, sql: str, **more: object) -> None:
    of(name, source, lambda df: update(df, filter, spec, **({"multi": True} | more)), sql)


NOW = datetime(2026, 1, 2, 3, 4, 5, 678000, tzinfo=timezone.utc)
updated("update_set", order_docs, '{"status": "F"}', '{"$set": {"status": "closed", "sub.x": 99}, "$unset": {"opt": 1, "date": 1, "tags": 1}}', f"select _id, cust, case when status = 'F' then 'closed' else status end as status, total, case when status = 'F' then null else date end as date, priority, {{'x': case when status = 'F' then 99 else sub.x end, 'y': sub.y}} as sub, case when status = 'F' then null else tags end as tags, case when status = 'F' then null else opt end as opt from {ORDER_DOCS}")
updated("update_inc", "customer", '{"c_nationkey": {"$lt": 10}}', '{"$inc": {"c_custkey": 1000000, "visits": 1}, "$mul": {"c_acctbal": 2}, "$min": {"c_mktsegment": "C"}}', "select case when c_nationkey < 10 then c_custkey + 1000000 else c_custkey end as c_custkey, c_name, c_nationkey, case when c_nationkey < 10 then c_acctbal * 2 else c_acctbal end as c_acctbal, case when c_nationkey < 10 then least(c_mktsegment, 'C') else c_mktsegment end as c_mktsegment, case when c_nationkey < 10 then 1::bigint end as visits from customer")
TAGGED = "select _id, tags from (select _id, {new} as tags from {docs})"
of("update_push", order_docs, lambda df: find(update(df, '{"sub.x": 1}', '{"$push": {"tags": {"$each": ["a", "b"], "$position": 0, "$slice": 3}}}', multi=True), projection='{"tags": 1}'), TAGGED.format(docs=ORDER_DOCS, new="case when sub.x = 1 then list_slice(list_concat(['a', 'b'], coalesce(tags, []::varchar[])), 1, 3) else tags end"))
of("update_add_to_set", order_docs, lambda df: find(update(df, '{"sub.x": 2}', '{"$addToSet": {"tags": {"$each": ["t1", "zz"]}}}', multi=True), projection='{"tags": 1}'), TAGGED.format(docs=ORDER_DOCS, new="case when sub.x = 2 then list_concat(coalesce(tags, []::varchar[]), list_filter(['t1', 'zz'], lambda t: not list_contains(coalesce(tags, []::varchar[]), t))) else tags end"))
of("update_pull", order_docs, lambda df: find(update(df, "{}", '{"$pull": {"tags": {"$in": ["t1", "t3"]}}}', multi=True), projection='{"tags": 1}'), TAGGED.format(docs=ORDER_DOCS, new="list_filter(tags, lambda t: t not in ('t1', 't3'))"))
of("update_pop", order_docs, lambda df: find(update(df, "{}", '{"$pop": {"tags": -1}}', multi=True), projection='{"tags": 1}'), TAGGED.format(docs=ORDER_DOCS, new="tags[2:]"))
of("update_rename", "region", lambda df: update(df, '{"r_regionkey": {"$gt": 2}}', '{"$rename": {"r_name": "title"}, "$currentDate": {"seen": true}}', multi=True, now=NOW), "select r_regionkey, case when r_regionkey > 2 then null else r_name end as r_name, case when r_regionkey > 2 then timestamp '2026-01-02 03:04:05.678' end as seen, case when r_regionkey > 2 then r_name end as title from region")
of("update_one", order_docs, lambda df: find(update(df, '{"status": "O", "sub.x": 2}', '{"$set": {"cust": -1}}'), '{"cust": -1}'), f"select * replace (-1::bigint as cust) from {ORDER_DOCS} where status = 'O' and sub.x = 2 order by _id limit 1")
of("update_upsert", order_docs, lambda df: find(update(df, '{"_id": -5, "cust": {"$gt": 3}}', '{"$set": {"total": 1.5}, "$setOnInsert": {"sub.y": "new"}, "$push": {"tags": "t"}}', upsert=True), '{"_id": {"$lt": 3}}'), f"select * from {ORDER_DOCS} where _id < 3 union all select -5, null, null, 1.5, null, null, {{'x': null, 'y': 'new'}}, ['t'], null")
of("update_replace", order_docs, lambda df: find(update(df, '{"_id": 1}', '{"cust": 3, "status": "Z"}'), '{"_id": {"$lte": 2}}', projection='{"cust": 1, "status": 1, "total": 1}'), f"select _id, case when _id = 1 then 3 else cust end as cust, case when _id = 1 then 'Z' else status end as status, case when _id <> 1 then total end as total from {ORDER_DOCS} where _id <= 2")
of("delete_many", "orders", lambda df: delete(df, '{"o_orderstatus": {"$ne": "P"}}'), "select * from orders where o_orderstatus = 'P'")
of("insert_rows", "nation", lambda df: insert(df.withColumnRenamed("n_nationkey", "_id"), df.withColumnRenamed("n_nationkey", "_id").where("_id < 3").withColumn("_id", F.col("_id") + 100)), "select n_nationkey as _id, n_name, n_regionkey from nation union all select n_nationkey + 100, n_name, n_regionkey from nation where n_nationkey < 3")

# ---- versions and pages

of("snapshot_count", "events", lambda df: count(df, '{"event_id": {"$lte": 5000}}'), "select count(*) as n from events where event_id <= 5000")
of("geo_within_polygon", place_docs, lambda df: find(df, '{"loc": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[[0, -20], [40, -20], [40, 25], [0, 25], [0, -20]]]}}}}', projection='{"name": 1}'), None)
of("geo_intersects", place_docs, lambda df: find(df, '{"loc": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [[[100, 40], [140, 40], [120, 60], [100, 40]]]}}}}', projection='{"name": 1}'), None)
