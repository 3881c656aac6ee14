"""Key-space queries over a space made of the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geohash
from tessera.operators.kv import KeySpace, run
from tessera.operators.kv import geo, hashes, keys, lists, strings, zsets
from tessera.sample import EXPIRING, LISTS, NOW_MS, SCORES, SETS, key_space

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def of(name: str, query: Callable[[KeySpace], DataFrame], sql: str | None) -> None:
    QUERIES[name] = (lambda s, d: query(key_space(s, d)), sql)


def command(name: str, sql: str | None, *words: object) -> None:
    """A reading command's rows."""
    of(name, lambda s: run(s, *words), sql)


def member_of(key: str) -> str:
    return f"select member from {SETS} where key = '{key}'"


def scores_of(key: str) -> str:
    return f"(select member, score from {SCORES} where key = '{key}')"


# ---- sets

command("set_members", member_of("S:view"), "SMEMBERS", "S:view")
command("set_inter", f"{member_of('S:view')} intersect {member_of('S:click')}", "SINTER", "S:view", "S:click")
command("set_union", f"{member_of('S:view')} union {member_of('S:click')} union {member_of('S:purchase')}", "SUNION", "S:view", "S:click", "S:purchase")
command("set_diff", f"{member_of('S:view')} except {member_of('S:click')}", "SDIFF", "S:view", "S:click")
command("set_intercard", f"select count(*) as reply from ({member_of('S:view')} intersect {member_of('S:click')})", "SINTERCARD", 2, "S:view", "S:click")
command("set_is_members", f"select i as at, m as member, cast(m in ({member_of('S:view')}) as integer) as there from (values (0, '1'), (1, 'none'), (2, '7')) t(i, m)", "SMISMEMBER", "S:view", "1", "none", "7")
of("set_store", lambda s: run(run(s, "SINTERSTORE", "S:both", "S:view", "S:click").space, "SCARD", "S:both"), f"select count(*) as reply from ({member_of('S:view')} intersect {member_of('S:click')})")
of("set_add_remove", lambda s: run(run(run(s, "SADD", "S:view", "new", "new", "1").space, "SREM", "S:view", "2", "none").space, "SMEMBERS", "S:view"), f"select member from ({member_of('S:view')} union select unnest(['new', '1'])) where member not in ('2', 'none')")
of("set_cards", lambda s: s.all_elements("set").groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"select key, count(*) as n from {SETS} group by 1")

# ---- scored sets

command("zset_union", f"select member, sum(score) as score from (select member, score * 2 as score from {scores_of('Z:view')} union all select member, score * 0.5::double from {scores_of('Z:click')}) group by 1", "ZUNION", 2, "Z:view", "Z:click", "WEIGHTS", 2, 0.5)
command("zset_union_max", f"select member, max(score) as score from (select * from {scores_of('Z:view')} union all select member, 1.0 from ({member_of('S:click')})) group by 1", "ZUNION", 2, "Z:view", "S:click", "AGGREGATE", "MAX")
command("zset_inter", f"select member, least(v.score, c.score) as score from {scores_of('Z:view')} v join {scores_of('Z:click')} c using (member)", "ZINTER", 2, "Z:view", "Z:click", "AGGREGATE", "MIN")
command("zset_diff", f"select member, score from {scores_of('Z:view')} where member not in (select member from {scores_of('Z:click')})", "ZDIFF", 2, "Z:view", "Z:click")
command("zset_intercard", f"select least(5, count(*)) as reply from {scores_of('Z:view')} join {scores_of('Z:click')} using (member)", "ZINTERCARD", 2, "Z:view", "Z:click", "LIMIT", 5)
of("zset_rank", lambda s: zsets.ranked(s.all_elements("zset").where(F.col("key").startswith("Z:")), by="key").select("key", "member", "rank"), f"select key, member, row_number() over (partition by key order by score, member) - 1 as rank from {SCORES}")
command("zset_range_rank", f"select member, score from {scores_of('Z:view')} order by score desc, member desc limit 5", "ZRANGE", "Z:view", -5, -1)
command("zset_range_reverse", f"select member, score from {scores_of('Z:view')} order by score desc, member desc limit 4 offset 2", "ZREVRANGE", "Z:view", 2, 5)
command("zset_range_score", f"select member, score from {scores_of('Z:view')} where score > 120 and score <= 300 order by score, member limit 20 offset 3", "ZRANGEBYSCORE", "Z:view", "(120", 300, "LIMIT", 3, 20)
command("zset_range_lex", f"select member, score from {scores_of('Z:click')} where member >= '10' and member < '2'", "ZRANGE", "Z:click", "[10", "(2", "BYLEX")
command("zset_count", f"select count(*) as reply from {scores_of('Z:view')} where score >= 110 and score < 150", "ZCOUNT", "Z:view", 110, "(150")
of("zset_pop_min", lambda s: run(s, "ZPOPMIN", "Z:click", 3).reply, f"select row_number() over (order by score, member) - 1 as rank, member, score from {scores_of('Z:click')} qualify rank < 3")
of("zset_pop_max_left", lambda s: run(run(s, "ZPOPMAX", "Z:click", 3).space, "ZCARD", "Z:click"), f"select greatest(count(*) - 3, 0) as reply from {scores_of('Z:click')}")
of("zset_remove_range", lambda s: run(run(s, "ZREMRANGEBYSCORE", "Z:view", "-inf", "(150").space, "ZRANGE", "Z:view", 0, -1), f"select member, score from {scores_of('Z:view')} where score >= 150")
of("zset_add", lambda s: run(run(s, "ZADD", "Z:view", "GT", "CH", 1, "1", 1e6, "2", 5, "fresh").space, "ZMSCORE", "Z:view", "1", "2", "fresh"), f"select i as at, m as member, case m when '2' then 1e6 when 'fresh' then 5 else coalesce((select max(score) from {scores_of('Z:view')} where member = '1'), 1) end as score from (values (0, '1'), (1, '2'), (2, 'fresh')) t(i, m)")

# ---- lists

PLACED = f"(select key, value, row_number() over (partition by key order by idx) - 1 as pos, count(*) over (partition by key) as n from {LISTS})"
of("list_range", lambda s: lists.ranges(s.all_elements("list"), 1, -2, "key").select("key", "pos", "value"), f"select key, pos, value from {PLACED} where pos >= 1 and pos <= n - 2")
of("list_pos", lambda s: lists.positions(s.all_elements("list"), "user", -1, 2, by="key").select("key", "nth", "pos"), f"select key, nth, pos from (select key, pos, row_number() over (partition by key order by pos desc)::integer as nth from {PLACED} where value = 'user') where nth <= 2")
of("list_rem", lambda s: lists.removed(s.all_elements("list"), F.lit("user"), 1, "key").select("key", "idx", "value"), f"select key, idx, value from (select *, row_number() over (partition by key, value order by idx) as nth from {LISTS}) where not (value = 'user' and nth = 1)")
of("list_trim", lambda s: run(run(s, "LTRIM", "L:3", 1, 2).space, "LRANGE", "L:3", 0, -1), f"select pos - 1 as pos, value from {PLACED} where key = 'L:3' and pos between 1 and 2")
of("list_push_pop", lambda s: run(run(run(s, "LPUSH", "L:1", "a", "b").space, "RPOP", "L:1").space, "LRANGE", "L:1", 0, 2), f"select row_number() over (order by o) - 1 as pos, value from (select -2 as o, 'b' as value union all select -1, 'a' union all select pos, value from {PLACED} where key = 'L:1' and pos < n - 1) qualify row_number() over (order by o) <= 3")
of("list_lengths", lambda s: s.all_elements("list").groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"select key, count(*) as n from {LISTS} group by 1")

# ---- hashes

of("hash_get_all", lambda s: hashes.maps(s).select("key", F.col("fields")["name"].alias("name"), F.col("fields")["segment"].alias("segment")), "select 'H:' || c_custkey as key, c_name as name, c_mktsegment as segment from customer")
command("hash_fields", "select unnest(['name', 'nation', 'segment']) as field, unnest([c_name, cast(c_nationkey as varchar), c_mktsegment]) as value from customer where c_custkey = 7", "HGETALL", "H:7")
of("hash_incrby", lambda s: run(run(s, "HINCRBY", "H:7", "nation", 100).space, "HGET", "H:7", "nation"), "select cast(c_nationkey + 100 as varchar) as reply from customer where c_custkey = 7")
of("hash_set_delete", lambda s: run(run(run(s, "HSET", "H:7", "seen", "1", "name", "x").space, "HDEL", "H:7", "segment").space, "HGETALL", "H:7"), "select unnest(['name', 'nation', 'seen']) as field, unnest(['x', cast(c_nationkey as varchar), '1']) as value from customer where c_custkey = 7")

# ---- strings

of("str_len", strings.lengths, "select 'D:' || doc_id as key, octet_length(encode(text)) as length from documents")
of("str_range", lambda s: s.live().where(F.col("type") == "string").select("key", strings.byte_range(F.regexp_replace("payload", r"[^\x20-\x7E]", ""), 0, 9).alias("head")), r"select 'D:' || doc_id as key, substr(regexp_replace(text, '[^\x20-\x7E]', '', 'g'), 1, 10) as head from documents")
of("str_append", lambda s: run(run(s, "APPEND", "D:5", "!").space, "STRLEN", "D:5"), "select octet_length(encode(text)) + 1 as reply from documents where doc_id = 5")
of("str_mget", lambda s: run(run(s, "SET", "k", "v").space, "MGET", "k", "none", "D:5", "k").select("at", F.length("value").alias("n")), "select i as at, case k when 'k' then 1 when 'D:5' then (select length(text) from documents where doc_id = 5) end as n from (values (0, 'k'), (1, 'none'), (2, 'D:5'), (3, 'k')) t(i, k)")

# ---- keys and expiry

other = lambda s: replace(s, db=1)
LIVE = f"(select * from {EXPIRING} where expire_ms = 0 or expire_ms > {NOW_MS})"
of("ttl_live", lambda s: other(s).live().select("key", "type", "expire_ms"), f"select key, type, expire_ms from {LIVE}")
of("ttl_left", lambda s: other(s).live().select("key", keys.time_left(s, 1000, False).alias("ttl")), f"select key, case when expire_ms = 0 then -1 else cast(floor((expire_ms - {NOW_MS} + 500) / 1000) as bigint) end as ttl from {LIVE}")
of("keystats", lambda s: keys.keystats(other(s)), f"select type, count(*) as keys, count(*) filter (where expire_ms <> 0) as expiring from {LIVE} group by 1")
of("keys_glob", lambda s: run(other(s), "KEYS", "E:1?[0-4]"), f"select key from {LIVE} where regexp_matches(key, '^E:1.[0-4]$')")
of("key_scan", lambda s: run(s, "SCAN", "D:2", "COUNT", 50, "MATCH", "D:*"), "select key from (select 'D:' || doc_id as key from documents union all select 'G:places' union all select distinct 'H:' || c_custkey from customer union all select distinct 'L:' || conv_id from conversations union all select distinct 'S:' || event_type from events union all select distinct 'Z:' || event_type from events) where key > 'D:2' order by key limit 50")

# ---- more commands, one each

HELD = "(select unnest(['name', 'nation', 'segment']) as field, unnest([c_name, cast(c_nationkey as varchar), c_mktsegment]) as value from customer where c_custkey = 7)"
COUNT_OF = "select count(*) as reply from ({})"


def after(name: str, write: tuple[object, ...], read: tuple[object, ...], sql: str) -> None:
    """What a reading command finds after a writing one."""
    of(name, lambda s: run(run(s, *write).space, *read), sql)


def reply(name: str, words: tuple[object, ...], sql: str) -> None:
    """A writing command's reply."""
    of(name, lambda s: run(s, *words).reply, sql)


command("hash_mget", f"select i as at, f as field, value from (values (0, 'segment'), (1, 'none'), (2, 'name')) t(i, f) left join {HELD} on field = f", "HMGET", "H:7", "segment", "none", "name")
command("hash_len", COUNT_OF.format(f"from {HELD}"), "HLEN", "H:7")
command("hash_exists", COUNT_OF.format(f"from {HELD} where field = 'segment'"), "HEXISTS", "H:7", "segment")
command("hash_strlen", f"select octet_length(encode(value)) as reply from {HELD} where field = 'name'", "HSTRLEN", "H:7", "name")
command("hash_keys", f"select field from {HELD}", "HKEYS", "H:7")
command("hash_vals", f"select value from {HELD}", "HVALS", "H:7")
after("hash_mset", ("HMSET", "H:7", "name", "n", "z", "1"), ("HGETALL", "H:7"), f"select field, case when field = 'name' then 'n' else value end as value from {HELD} union all select 'z', '1'")
after("hash_setnx", ("HSETNX", "H:7", "name", "other"), ("HGET", "H:7", "name"), f"select value as reply from {HELD} where field = 'name'")
after("hash_incrby_float", ("HINCRBYFLOAT", "H:7", "nation", "0.5"), ("HGET", "H:7", "nation"), f"select value || '.5' as reply from {HELD} where field = 'nation'")

command("set_is_member", COUNT_OF.format(f"{member_of('S:view')} and member = '1'"), "SISMEMBER", "S:view", "1")
after("set_union_store", ("SUNIONSTORE", "S:all", "S:view", "S:click"), ("SCARD", "S:all"), COUNT_OF.format(f"{member_of('S:view')} union {member_of('S:click')}"))
after("set_diff_store", ("SDIFFSTORE", "S:only", "S:view", "S:click"), ("SMEMBERS", "S:only"), f"{member_of('S:view')} except {member_of('S:click')}")
after("set_pop", ("SPOP", "S:view", 3), ("SCARD", "S:view"), f"select greatest(count(*) - 3, 0) as reply from ({member_of('S:view')})")
after("set_move", ("SMOVE", "S:view", "S:new", "1"), ("SMEMBERS", "S:new"), f"{member_of('S:view')} and member = '1'")

command("zset_score", f"select score as reply from {scores_of('Z:view')} where member = '7'", "ZSCORE", "Z:view", "7")
command("zset_lex_count", COUNT_OF.format(f"from {scores_of('Z:click')} where member >= '10' and member < '2'"), "ZLEXCOUNT", "Z:click", "[10", "(2")
command("zset_range_by_lex", f"select member, score from {scores_of('Z:click')} where member > '3'", "ZRANGEBYLEX", "Z:click", "(3", "+")
command("zset_reverse_by_lex", f"select member, score from {scores_of('Z:click')} where member <= '3'", "ZREVRANGEBYLEX", "Z:click", "[3", "-")
command("zset_reverse_by_score", f"select member, score from {scores_of('Z:view')} where score >= 120 and score <= 300", "ZREVRANGEBYSCORE", "Z:view", 300, 120)
after("zset_rem", ("ZREM", "Z:view", "1", "2", "none"), ("ZRANGE", "Z:view", 0, -1), f"select member, score from {scores_of('Z:view')} where member not in ('1', '2')")
after("zset_incrby", ("ZINCRBY", "Z:view", 2.5, "7"), ("ZSCORE", "Z:view", "7"), f"select coalesce((select score from {scores_of('Z:view')} where member = '7'), 0) + 2.5 as reply")
after("zset_remove_by_rank", ("ZREMRANGEBYRANK", "Z:view", 0, -3), ("ZRANGE", "Z:view", 0, -1), f"select member, score from {scores_of('Z:view')} order by score desc, member desc limit 2")
after("zset_remove_by_lex", ("ZREMRANGEBYLEX", "Z:view", "-", "(3"), ("ZRANGE", "Z:view", 0, -1), f"select member, score from {scores_of('Z:view')} where member >= '3'")
after("zset_range_store", ("ZRANGESTORE", "Z:low", "Z:view", 0, 4), ("ZRANGE", "Z:low", 0, -1), f"select member, score from {scores_of('Z:view')} order by score, member limit 5")
after("zset_union_store", ("ZUNIONSTORE", "Z:all", 2, "Z:view", "Z:click"), ("ZCARD", "Z:all"), COUNT_OF.format(f"select member from {scores_of('Z:view')} union select member from {scores_of('Z:click')}"))
after("zset_inter_store", ("ZINTERSTORE", "Z:both", 2, "Z:view", "Z:click"), ("ZCARD", "Z:both"), COUNT_OF.format(f"select member from {scores_of('Z:view')} intersect select member from {scores_of('Z:click')}"))
after("zset_diff_store", ("ZDIFFSTORE", "Z:only", 2, "Z:view", "Z:click"), ("ZRANGE", "Z:only", 0, -1), f"select member, score from {scores_of('Z:view')} where member not in (select member from {scores_of('Z:click')})")

command("list_index", f"select value as reply from {PLACED} where key = 'L:1' and pos = n - 1", "LINDEX", "L:1", -1)
command("list_len", COUNT_OF.format(f"from {LISTS} where key = 'L:1'"), "LLEN", "L:1")
reply("list_pop_left", ("LPOP", "L:1", 2), f"select pos as at, value from {PLACED} where key = 'L:1' and pos < 2")
after("list_push_right", ("RPUSHX", "L:1", "end"), ("LRANGE", "L:1", -1, -1), "select count(*) as pos, 'end' as value from conversations where conv_id = 1")
after("list_rotate", ("RPOPLPUSH", "L:1", "L:new"), ("LRANGE", "L:new", 0, -1), f"select 0 as pos, value from {PLACED} where key = 'L:1' and pos = n - 1")

command("str_get", "select text as reply from documents where doc_id = 5", "GET", "D:5")
reply("str_get_set", ("GETSET", "D:5", "x"), "select text as reply from documents where doc_id = 5")
after("str_set_ex", ("SETEX", "D:5", 9, "x"), ("PTTL", "D:5"), "select 9000 as reply")
after("str_decr", ("DECRBY", "n", 7), ("GET", "n"), "select '-7' as reply")
after("key_delete", ("DEL", "D:5", "D:6", "none"), ("EXISTS", "D:5", "D:7"), "select count(*) as reply from documents where doc_id = 7")
after("key_unlink", ("UNLINK", "S:view"), ("TYPE", "S:view"), "select 'none' as reply")
after("key_rename", ("RENAME", "S:view", "S:seen"), ("SCARD", "S:seen"), COUNT_OF.format(member_of("S:view")))
command("key_exists", "select (select count(*) from documents where doc_id = 5) * 2 as reply", "EXISTS", "D:5", "D:5", "none")
after("key_expire_time", ("PEXPIREAT", "D:5", NOW_MS + 5000), ("PEXPIRETIME", "D:5"), f"select {NOW_MS + 5000} as reply")

THERE = "select case when exists(select 1 from documents where doc_id = 5) then 0 else 1 end as reply"
command("key_touch", COUNT_OF.format("from documents where doc_id in (5, 7)"), "TOUCH", "D:5", "none", "D:7")
reply("key_rename_new", ("RENAMENX", "D:5", "D:5"), THERE)
#: Which key comes is chance: it is one of those that live.
of("key_random", lambda s: run(other(s), "RANDOMKEY").join(other(s).live(), "key", "left_semi").agg(F.count(F.lit(1)).alias("n")), f"select least(1, count(*)) as n from {LIVE}")
of("key_move", lambda s: run(replace(run(s, "MOVE", "D:5", 2).space, db=2), "GET", "D:5"), "select text as reply from documents where doc_id = 5")
of("db_size", lambda s: run(other(s), "DBSIZE"), f"select count(*) as reply from {LIVE}")
of("flush_db", lambda s: (lambda t: run(t, "DBSIZE").unionByName(run(replace(t, db=0), "SCARD", "S:view")))(run(other(s), "FLUSHDB").space), f"select 0 as reply union all {COUNT_OF.format(member_of('S:view'))}")
after("flush_all", ("FLUSHALL",), ("DBSIZE",), "select 0 as reply")
after("key_expire", ("EXPIRE", "D:5", 100), ("TTL", "D:5"), "select 100 as reply")
after("key_pexpire", ("PEXPIRE", "D:5", 1500), ("PTTL", "D:5"), "select 1500 as reply")
after("key_expire_at", ("EXPIREAT", "D:5", NOW_MS // 1000 + 60), ("EXPIRETIME", "D:5"), f"select {NOW_MS // 1000 + 60} as reply")
of("key_persist", lambda s: run(run(run(s, "EXPIRE", "D:5", 100).space, "PERSIST", "D:5").space, "PTTL", "D:5"), "select -1 as reply")
command("hash_scan", f"select field, value from {HELD} order by field limit 2", "HSCAN", "H:7", "0", "COUNT", 2)
command("set_scan", f"{member_of('S:view')} and member > '3' order by member limit 20", "SSCAN", "S:view", "3", "COUNT", 20)
command("zset_scan", f"select member, score from (select * from {scores_of('Z:click')} order by member limit 30) where member like '1%'", "ZSCAN", "Z:click", "0", "MATCH", "1*", "COUNT", 30)

reply("str_get_del", ("GETDEL", "D:5"), "select text as reply from documents where doc_id = 5")
after("str_get_ex", ("GETEX", "D:5", "EX", 30), ("PTTL", "D:5"), "select 30000 as reply")
after("str_mset", ("MSET", "a", "1", "D:5", "2"), ("MGET", "a", "D:5"), "select * from (values (0, 'a', '1'), (1, 'D:5', '2')) t(\"at\", key, value)")
after("str_mset_new", ("MSETNX", "D:5", "x", "new", "y"), ("EXISTS", "new"), THERE)
reply("str_set_new", ("SETNX", "D:5", "x"), THERE)
after("str_pset_ex", ("PSETEX", "D:5", 1500, "v"), ("PTTL", "D:5"), "select 1500 as reply")
of("str_incr", lambda s: run(run(run(s, "INCR", "n").space, "INCRBY", "n", 41).space, "GET", "n"), "select '42' as reply")
after("str_decr_one", ("DECR", "n"), ("GET", "n"), "select '-1' as reply")
of("str_incr_float", lambda s: run(run(run(s, "SET", "n", "10.50").space, "INCRBYFLOAT", "n", "0.1").space, "GET", "n"), "select '10.6' as reply")
reply("str_set_range", ("SETRANGE", "D:5", 4, "abcdef"), "select greatest(octet_length(encode(text)), 10) as reply from documents where doc_id = 5")
after("str_get_range", ("SETRANGE", "D:5", 4, "abcdef"), ("GETRANGE", "D:5", 4, 9), "select 'abcdef' as reply")
after("str_substr", ("APPEND", "D:5", "-end"), ("SUBSTR", "D:5", -4, -1), "select '-end' as reply")

#: Which fields and members come is chance: they are different ones, all of the key.
of("hash_random", lambda s: run(s, "HRANDFIELD", "H:7", 2).distinct().join(run(s, "HKEYS", "H:7"), "field", "left_semi").agg(F.count(F.lit(1)).alias("n")), f"select least(2, count(*)) as n from {HELD}")
of("zset_random", lambda s: run(s, "ZRANDMEMBER", "Z:view", 4).distinct().join(run(s, "ZRANGE", "Z:view", 0, -1), "member", "left_semi").agg(F.count(F.lit(1)).alias("n")), f"select least(4, count(*)) as n from {scores_of('Z:view')}")
for _name, _word, _order in (("zset_rank_one", "ZRANK", "score, member"), ("zset_reverse_rank", "ZREVRANK", "score desc, member desc")):
    command(_name, f"select rank as reply from (select member, row_number() over (order by {_order}) - 1 as rank from {scores_of('Z:view')}) where member = '7'", _word, "Z:view", "7")

ONE = f"(select pos, value, n from {PLACED} where key = 'L:1')"
after("list_push_both", ("RPUSH", "L:1", "x", "y"), ("LRANGE", "L:1", -3, -1), f"select pos, value from {ONE} where pos = n - 1 union all select count(*), 'x' from {ONE} union all select count(*) + 1, 'y' from {ONE}")
after("list_push_left", ("LPUSHX", "L:1", "x"), ("LRANGE", "L:1", 0, 1), f"select 0 as pos, 'x' as value union all select pos + 1, value from {ONE} where pos = 0")
after("list_set", ("LSET", "L:1", -1, "x"), ("LRANGE", "L:1", 0, -1), f"select pos, case when pos = n - 1 then 'x' else value end as value from {ONE}")
after("list_rem_one", ("LREM", "L:1", -1, "user"), ("LRANGE", "L:1", 0, -1), f"select row_number() over (order by pos) - 1 as pos, value from (select pos, value, row_number() over (partition by value order by pos desc) as nth from {ONE}) where not (value = 'user' and nth = 1)")
after("list_insert", ("LINSERT", "L:1", "BEFORE", "assistant", "x"), ("LRANGE", "L:1", 0, -1), f"select row_number() over (order by o) - 1 as pos, value from (select pos * 2 as o, value from {ONE} union all select min(pos) * 2 - 1, 'x' from {ONE} where value = 'assistant' having count(*) > 0)")
command("list_pos_one", f"select nth, pos from (select pos, row_number() over (order by pos desc) as nth from {ONE} where value = 'user') where nth <= 2", "LPOS", "L:1", "user", "RANK", -1, "COUNT", 2)
after("list_move", ("LMOVE", "L:1", "L:2", "LEFT", "RIGHT"), ("LRANGE", "L:2", -1, -1), f"select (select count(*) from conversations where conv_id = 2) as pos, value from {ONE} where pos = 0")

# ---- places

LONLAT = "(select c_name as member, (c_custkey * 7919 % 36000) / 100.0::double - 180 as lon, (c_custkey * 104729 % 17000) / 100.0::double - 85 as lat from customer)"


def _cell(steps: str) -> str:
    return " + ".join(f"((({steps}) >> {i}) & 1) * {1 << 2 * i}" for i in range(26))


CELLS = f"""(select member, lon, lat, ({_cell('ilat')}) + 2 * ({_cell('ilon')}) as cell, ilon, ilat from
  (select member, lon, lat, least(cast(floor((lon + 180.0) / 360.0 * 67108864) as bigint), 67108863) as ilon,
    least(cast(floor((lat + 85.05112878) / 170.10225756 * 67108864) as bigint), 67108863) as ilat from {LONLAT}))"""
CENTRES = f"(select member, cell, -180.0 + (ilon + 0.5::double) / 67108864 * 360.0 as x, -85.05112878::double + (ilat + 0.5::double) / 67108864 * 170.10225756::double as y from {CELLS})"
ARC = "2 * 6372797.560856 * asin(least(1.0, sqrt(pow(sin((radians(y) - radians({lat})) / 2), 2) + cos(radians({lat})) * cos(radians(y)) * pow(sin((radians(x) - radians({lon})) / 2), 2))))"
of("geo_hash", lambda s: s.all_elements("zset").where("key = 'G:places'").select("member", F.col("score").cast("bigint").alias("cell")), f"select member, cast(cell as bigint) as cell from {CELLS}")
of("geo_decode", lambda s: geo.positioned(s.all_elements("zset").where("key = 'G:places'")).select("member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")), f"select member, round(x, 6) as lon, round(y, 6) as lat from {CENTRES}")
of("geo_search_radius", lambda s: run(s, "GEOSEARCH", "G:places", "FROMLONLAT", 20, 30, "BYRADIUS", 1500, "km", "ASC").select("member", F.round("dist", 2).alias("dist")), f"select member, round({ARC.format(lon=20, lat=30)} / 1000, 2) as dist from {CENTRES} where {ARC.format(lon=20, lat=30)} <= 1500000")
of("geo_search_topk", lambda s: run(s, "GEOSEARCH", "G:places", "FROMLONLAT", -60, -20, "BYRADIUS", 9000, "mi", "COUNT", 7).select("member"), f"select member from {CENTRES} where {ARC.format(lon=-60, lat=-20)} <= 9000 * 1609.34 order by {ARC.format(lon=-60, lat=-20)}, member limit 7")
of("geo_search_box", lambda s: run(s, "GEOSEARCH", "G:places", "FROMLONLAT", 20, 30, "BYBOX", 4000, 2000, "km").select("member"), f"select member from {CENTRES} where 6372797.560856 * abs(radians(y) - radians(30)) <= 1000000 and 2 * 6372797.560856 * asin(sqrt(pow(cos(radians(y)), 2) * pow(sin((radians(x) - radians(20)) / 2), 2))) <= 2000000")
#: Names run over all latitudes: the centre is cut into 26 steps of longitude and latitude each, five bits a letter.
STANDARD = f"(select member, ({_cell('slat')}) + 2 * ({_cell('slon')}) as bits from (select member, cast(floor((x + 180) / 360 * 67108864) as bigint) as slon, cast(floor((y + 90) / 180 * 67108864) as bigint) as slat from {CENTRES}))"
SPELT = " || ".join(f"substr('{geohash.LETTERS}', cast((cast(bits as bigint) >> {47 - 5 * i}) & 31 as integer) + 1, 1)" for i in range(10))
of("geo_names", lambda s: s.all_elements("zset").where("key = 'G:places'").select("member", geohash.name(F.col("score")).alias("hash")), f"select member, {SPELT} || '0' as hash from {STANDARD}")
#: Which members come is chance: there are five different ones, all of the set.
of("random_members", lambda s: run(s, "SRANDMEMBER", "S:view", 5).toDF("member").distinct().join(run(s, "SMEMBERS", "S:view"), "member", "left_semi").agg(F.count(F.lit(1)).alias("n")), f"select least(5, count(*)) as n from ({member_of('S:view')})")

SEVEN, NINE = "Customer#000000007", "Customer#000000009"
FROM_SEVEN = f"(select c.member, c.cell, c.x, c.y, s.x as sx, s.y as sy from {CENTRES} c, {CENTRES} s where s.member = '{SEVEN}')"
APART = ARC.format(lon="sx", lat="sy")
NEAR = f"select member from {CENTRES} where {ARC.format(lon=20, lat=30)} <= 1500000"
NEAR_SEVEN = f"select member from {FROM_SEVEN} where {APART} <= 2500000"
after("geo_add", ("GEOADD", "G:places", 2.35, 48.85, "new"), ("ZCARD", "G:places"), "select count(*) + 1 as reply from customer")
of("geo_pos", lambda s: run(s, "GEOPOS", "G:places", SEVEN, "none").select("at", "member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")), f"select i as at, m as member, round(x, 6) as lon, round(y, 6) as lat from (values (0, '{SEVEN}'), (1, 'none')) t(i, m) left join {CENTRES} on member = m")
of("geo_dist", lambda s: run(s, "GEODIST", "G:places", SEVEN, NINE, "km").select(F.round("reply", 2).alias("reply")), f"select round({APART} / 1000, 2) as reply from {FROM_SEVEN} where member = '{NINE}'")
for _word in ("GEORADIUS", "GEORADIUS_RO"):
    of(_word.lower().replace("georadius", "geo_radius_of"), lambda s, w=_word: run(s, w, "G:places", 20, 30, 1500, "km").select("member"), NEAR)
for _word in ("GEORADIUSBYMEMBER", "GEORADIUSBYMEMBER_RO"):
    of(_word.lower().replace("georadiusbymember", "geo_radius_by_member"), lambda s, w=_word: run(s, w, "G:places", SEVEN, 2500, "km").select("member"), NEAR_SEVEN)
after("geo_search_store", ("GEOSEARCHSTORE", "G:near", "G:places", "FROMMEMBER", SEVEN, "BYRADIUS", 2500, "km"), ("ZCARD", "G:near"), COUNT_OF.format(NEAR_SEVEN))
command("geo_hash_of", f"select i as at, m as member, hash from (values (0, '{SEVEN}'), (1, 'none')) t(i, m) left join (select member, {SPELT} || '0' as hash from {STANDARD}) on member = m", "GEOHASH", "G:places", SEVEN, "none")
