from __future__ import annotations

import math
from datetime import datetime, timezone

import pytest

from tessera.errors import QueryError
from tessera.functions import ejson
from tessera.operators.find import aggregate, distinct, find
from tessera.operators.updates import insert, update
from tessera.plans.stages import parse_pipeline
from tessera.sources import dynamic
from tessera.sources.catalog import Catalog, Cursor

DOCS = [(1, "a", 2, [1, 2], {"p": 1, "q": "x"}), (2, "b", None, [], None), (3, "a", 5, None, {"p": None, "q": "y"}), (4, None, 7, [2, 3], {"p": 4, "q": None})]
SCHEMA = "_id long, k string, n long, a array<long>, o struct<p:long,q:string>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).cache()


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize(("pipeline", "code"), [
    ('[{"$lookup": {}}]', 40324), ('[{"$match": 1}]', 15959), ('[{"$sort": {}}]', 15976), ('[{"$limit": 0}]', 15958), ('[{"$skip": -1}]', 15956), ('[{"$group": {}}]', 15955),
    ('[{"$group": {"_id": 1, "a.b": {"$sum": 1}}}]', 40235), ('[{"$group": {"_id": 1, "a": {"$stdDevPop": 1}}}]', 15952), ('[{"$project": {"a": 0, "b": 1}}]', 31254), ('[{"$project": {}}]', 51272),
    ('[{"$addFields": {"a": 1, "a.b": 2}}]', 31250), ('[{"$unwind": "a"}]', 28818), ('[{"$unwind": {"path": "$a", "foo": 1}}]', 28811), ('[{"$limit": 1}, {"$geoNear": {"near": [0, 0]}}]', 40602), ('[{"a": 1, "b": 2}]', 40323), ('[1]', 14),
])
def test_pipeline_errors(pipeline, code):
    with pytest.raises(QueryError) as e:
        parse_pipeline(pipeline)
    assert e.value.code == code


@pytest.mark.parametrize(("expr", "code"), [('{"$add": ["$k", 1]}', 16554), ('{"$foo": 1}', 168), ('"$$X"', 17276), ('{"$cond": {"if": 1, "then": 2}}', 17082), ('{"$ifNull": [1]}', 1257300), ('{"$concat": ["$n"]}', 16702), ('{"$subtract": [1]}', 16020), ('"$"', 16872)])
def test_expression_errors(docs, expr, code):
    with pytest.raises(QueryError) as e:
        aggregate(docs, '[{"$project": {"v": ' + expr + "}}]")
    assert e.value.code == code


def test_divide_by_zero(docs):
    with pytest.raises(Exception, match="can't \\$divide by zero"):
        aggregate(docs, '[{"$project": {"v": {"$divide": ["$n", 0]}}}]').collect()


def test_missing_and_null(docs):
    got = rows(aggregate(docs, '[{"$project": {"e": {"$eq": ["$none", null]}, "l": {"$lt": ["$none", null]}, "b": {"$eq": ["$n", "$none"]}, "t": {"$cond": ["$k", 1, 2]}}}, {"$sort": {"_id": 1}}]'))
    assert [(r["e"], r["l"], r["b"], r["t"]) for r in got] == [(False, True, False, 1), (False, True, True, 1), (False, True, False, 1), (False, True, False, 2)]


def test_nan_is_lowest(spark):
    df = spark.createDataFrame([(1, math.nan), (2, 1.0), (3, None), (4, -5.0)], "_id long, x double")
    assert [r["_id"] for r in find(df, sort='{"x": 1}').collect()] == [3, 1, 4, 2]
    got = rows(aggregate(df, '[{"$group": {"_id": null, "lo": {"$min": "$x"}, "hi": {"$max": "$x"}}}]'))[0]
    assert math.isnan(got["lo"]) and got["hi"] == 1.0


def test_sort_arrays(docs):
    assert [r["_id"] for r in find(docs, sort='{"a": 1}').collect()] == [2, 3, 1, 4]
    assert [r["_id"] for r in find(docs, sort='{"a": -1}').collect()] == [4, 1, 3, 2]


def test_order_of_first_push_and_sets(docs):
    got = rows(aggregate(docs, '[{"$sort": {"n": -1}}, {"$group": {"_id": "$k", "f": {"$first": "$n"}, "l": {"$last": "$n"}, "p": {"$push": "$_id"}, "s": {"$addToSet": "$o.q"}}}, {"$sort": {"_id": 1}}]'))
    assert got == [{"_id": None, "f": 7, "l": 7, "p": [4], "s": []}, {"_id": "a", "f": 5, "l": 2, "p": [3, 1], "s": ["y", "x"]}, {"_id": "b", "f": None, "l": None, "p": [2], "s": []}]


def test_unwind_preserve(docs):
    got = rows(aggregate(docs, '[{"$unwind": {"path": "$a", "includeArrayIndex": "i", "preserveNullAndEmptyArrays": true}}, {"$project": {"a": 1, "i": 1}}, {"$sort": {"_id": 1, "i": 1}}]'))
    assert [(r["_id"], r["a"], r["i"]) for r in got] == [(1, 1, 0), (1, 2, 1), (2, None, None), (3, None, None), (4, 2, 0), (4, 3, 1)]


def test_distinct(docs):
    assert [r["value"] for r in distinct(docs, "a").collect()] == [1, 2, 3]
    assert [r["value"] for r in distinct(docs, "o.q").collect()] == ["x", "y"]


def test_wide_arithmetic(spark):
    df = spark.createDataFrame([(1, (1 << 63) - 1)], "_id long, n long")
    assert rows(aggregate(df, '[{"$project": {"v": {"$add": ["$n", 1]}}}]', wide=True))[0]["v"] == 9.223372036854776e18
    with pytest.raises(Exception, match="OVERFLOW"):
        aggregate(df, '[{"$project": {"v": {"$add": ["$n", 1]}}}]').collect()


@pytest.mark.parametrize(("spec", "code"), [
    ('{"$set": {"a": 1}, "$inc": {"a": 1}}', 40), ('{"$set": {"a.b": 1}, "$unset": {"a": 1}}', 40), ('{"$foo": {"a": 1}}', 9), ('{"$set": {"": 1}}', 56), ('{"$inc": {"n": "x"}}', 14), ('{"$set": {"_id": 5}}', 66),
    ('{"$pop": {"a": 2}}', 9), ('{"$bit": {"n": 1}}', 2), ('{"$rename": {"n": "n"}}', 2), ('{"$set": {"k.x": 1}}', 28), ('{"$set": {"a.$": 1}}', 2),
])
def test_update_errors(docs, spec, code):
    with pytest.raises(QueryError) as e:
        update(docs, "{}", spec, multi=True)
    assert e.value.code == code


def test_updates(docs):
    now = datetime(2026, 1, 2, 3, 4, 5, 678000, tzinfo=timezone.utc)
    got = rows(update(docs, '{"_id": 1}', '{"$push": {"a": {"$each": [9, 0], "$sort": -1, "$slice": -3}}, "$set": {"o.r": 1.5}, "$currentDate": {"at": true}, "$mul": {"n": 3}}', now=now).orderBy("_id"))
    assert got[0]["a"] == [2, 1, 0] and got[0]["o"] == {"p": 1, "q": "x", "r": 1.5} and got[0]["n"] == 6 and got[0]["at"] == now.replace(tzinfo=None)
    assert got[3]["a"] == [2, 3] and got[3]["o"] == {"p": 4, "q": None, "r": None} and got[1]["at"] is None
    got = rows(update(docs, "{}", '{"$pullAll": {"a": [2]}, "$addToSet": {"b": "z"}, "$rename": {"k": "kk"}}', multi=True).orderBy("_id"))
    assert [r["a"] for r in got] == [[1], [], None, [3]] and got[0]["b"] == ["z"] and [r["kk"] for r in got] == ["a", "b", "a", None]
    got = rows(update(docs, '{"_id": 1}', '{"$set": {"a.3": 7}}').orderBy("_id"))
    assert got[0]["a"] == [1, 2, None, 7]
    got = rows(update(docs, '{"_id": 77, "o.q": "new"}', '{"$inc": {"n": 2}}', upsert=True).where("_id = 77"))
    assert got == [{"_id": 77, "k": None, "n": 2, "a": None, "o": {"p": None, "q": "new"}}]


def test_insert_twice(docs):
    with pytest.raises(Exception, match="E11000"):
        insert(docs, docs.where("_id = 1")).collect()


def test_ejson():
    v = ejson.parse('{"a": {"$numberLong": "5"}, "d": {"$date": "2020-01-01T00:00:00Z"}, "r": {"$regularExpression": {"pattern": "a", "options": "i"}}, "n": {"$numberDouble": "NaN"}}')
    assert v["a"] == 5 and v["d"].year == 2020 and v["r"].options == "i" and math.isnan(v["n"])
    assert ejson.format({"a": 1, "b": 1 << 40, "c": 1.5}) == '{"a":{"$numberInt":"1"},"b":{"$numberLong":"1099511627776"},"c":{"$numberDouble":"1.5"}}'
    assert ejson.format({"d": v["d"]}, False) == '{"d":{"$date":"2020-01-01T00:00:00.000Z"}}'
    with pytest.raises(QueryError):
        ejson.parse('{"a": 1, "a": 2}')


def test_catalog(spark, docs, tmp_path):
    now = [1000.0]
    c = Catalog(spark, str(tmp_path), clock=lambda: now[0])
    c.create("docs", docs)
    lease = c.snapshot(30)
    c.delete("docs", '{"k": "a"}')
    c.insert("docs", docs.where("_id = 1"))
    assert c.count("docs").first()["n"] == 3 and c.count("docs", lease=lease).first()["n"] == 4
    assert c.create_index("docs", {"k": 1}) == "k_1" and c.stats("docs")["indexes"] == ["k_1"]
    with pytest.raises(QueryError):
        c.create_index("docs", {"missing": 5})
    now[0] += 31
    with pytest.raises(QueryError, match="no such snapshot"):
        c.read("docs", lease)
    pages = Cursor(docs, rows=3)
    assert [r["_id"] for r in pages.next()] == [1, 2, 3] and [r["_id"] for r in pages.next()] == [4] and pages.next() == []


def test_missing_collections_are_empty(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create("e")
    assert c.count("e").first()["n"] == 0 and c.count("never").first()["n"] == 0 and c.find("e").collect() == []


def test_unique_on_every_write(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "_id long, u string")
    c.create("d", rows)
    c.create_index("d", {"_id": 1})
    c.create_index("d", {"u": 1}, unique=True, sparse=True)
    c.insert("d", spark.createDataFrame([(4, None)], "_id long, u string"))
    with pytest.raises(QueryError, match="E11000"):
        c.insert("d", spark.createDataFrame([(5, "y")], "_id long, u string"))
    assert c.count("d").first()["n"] == 4


def test_cursor_over_nulls_and_repeats(spark):
    rows = [(None, 1), (None, 2), (None, 3), (1, 4), (1, 5), (1, 6), (2, 7)]
    pages = Cursor(spark.createDataFrame(rows, "_id long, v long"), rows=2)
    assert sorted(r["v"] for r in pages) == [1, 2, 3, 4, 5, 6, 7]


def test_add_to_set_keeps_first_order(spark, docs):
    df = spark.createDataFrame([(i, i % 2, "bca"[i % 3]) for i in range(60)], "_id long, k long, v string")
    got = aggregate(df, '[{"$group": {"_id": "$k", "p": {"$addToSet": "$v"}, "n": {"$count": {}}}}]').collect()
    assert {r["_id"]: (r["p"], r["n"]) for r in got} == {0: (["b", "a", "c"], 30), 1: (["c", "b", "a"], 30)}


@pytest.mark.parametrize(("pattern", "options", "text", "hit"), [
    ("abc$", "", "abc\n", False), ("^b$", "m", "a\nb\nc", True), ("é", "i", "É", True), ("x.y", "", "x\ry", True), ("x.y", "", "x\ny", False), ("^[ ]$", "x", " ", True),
    ("a b # c", "x", "ab", True), ("[[:digit:]]+z", "", "12z", True), ("^[a&&b]+$", "", "&a", True), ("^[[x]$", "", "[", True), (r"^a\$$", "", "a$", True),
])
def test_regex_rules(spark, pattern, options, text, hit):
    df = spark.createDataFrame([(1, text)], "_id long, t string")
    assert bool(find(df, {"t": {"$regex": pattern, "$options": options}}).collect()) is hit


def test_find_sorts_only_when_asked(spark):
    df = spark.range(10).withColumnRenamed("id", "_id")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan(find(df, '{"_id": {"$gt": 3}}')) and "Sort" in plan(find(df, None, sort='{"_id": -1}'))


def test_dynamic(spark):
    df = dynamic.parse(spark.createDataFrame([('{"_id": 1, "v": 1}',), ('{"_id": 2, "v": 1.0}',), ('{"_id": 3, "v": "1"}',), ('{"_id": 4, "v": null}',), ('{"_id": 5}',), ('{"_id": 6, "v": [1]}',)], "t string"), "t")
    groups = {tuple(r["ids"]) for r in df.groupBy(dynamic.total_order("v").alias("k")).agg({"_id": "collect_list"}).withColumnRenamed("collect_list(_id)", "ids").selectExpr("sort_array(ids) as ids").collect()}
    assert groups == {(1, 2), (3,), (4, 5), (6,)}
    got = df.select("_id", dynamic.exists("v").alias("e"), dynamic.is_null("v").alias("n"), dynamic.type_of("v").alias("t")).orderBy("_id").collect()
    assert [(r["e"], r["n"], r["t"]) for r in got] == [(True, False, "number")] * 2 + [(True, False, "string"), (True, True, "null"), (False, False, "missing"), (True, False, "array")]
    assert [r["n"] for r in dynamic.shadow(df, n="v:bigint").orderBy("_id").collect()][0] == 1


def test_stream(spark, tmp_path):
    from tessera.streaming import events

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.where(events.read_events(spark, str(tmp_path / "in"), src.schema), '{"event_type": "view"}')
    q = events.windowed(stream, "1 day", "1 day", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == src.where("event_type = 'view'").count()
