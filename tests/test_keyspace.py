from __future__ import annotations

import re
from dataclasses import replace

import pytest

from tessera.errors import QueryError
from tessera.operators.kv import COMMANDS, KeySpace, run
from tessera.operators.kv.base import SCHEMAS, glob_regex


def spark_rows(space, name):
    return space.spark.createDataFrame(getattr(space, name).toArrow(), SCHEMAS[name])


class Session:
    """Commands one after another over one space."""

    def __init__(self, spark, now_ms=1_000_000):
        self.space = KeySpace.empty(spark, now_ms)

    def __call__(self, *words):
        out = run(self.space, *words)
        written = None
        if hasattr(out, "space"):
            written, out = out.space, out.reply
        got = [tuple(r) for r in out.collect()]
        if written is not None:  # the tables as rows: a session of many commands must not pile up plans
            fresh = {n: spark_rows(written, n) for n in SCHEMAS}
            self.space = replace(written, **fresh)
        return got[0][0] if len(got) == 1 and len(got[0]) == 1 else got


def test_every_command_is_there():
    assert len(COMMANDS) == 134


def test_strings(spark):
    s = Session(spark)
    assert s("SET", "a", "1") == "OK" and s("INCRBY", "a", 41) == 42 and s("GET", "a") == "42"
    assert s("APPEND", "a", "xyz") == 5 and s("GETRANGE", "a", -3, -1) == "xyz" and s("STRLEN", "a") == 5
    assert s("SETRANGE", "a", 1, "__") == 5 and s("GET", "a") == "4__yz"
    assert s("SET", "a", "no", "NX") is None and s("SETNX", "b", "x") == 1 and s("MSETNX", "b", "1", "c", "2") == 0
    assert s("INCRBYFLOAT", "f", "10.50") == "10.5" and s("INCRBYFLOAT", "f", "-10.5") == "0"
    assert s("GETDEL", "b") == "x" and s("EXISTS", "a", "a", "b") == 2 and s("TYPE", "zz") == "none"
    with pytest.raises(QueryError, match="not an integer"):
        s("INCR", "a")
    with pytest.raises(QueryError, match="WRONGTYPE"):
        s("LPUSH", "a", "x")
    with pytest.raises(QueryError, match="wrong number of arguments"):
        s("GET")


def test_expiry(spark):
    s = Session(spark)
    s("SET", "a", "1", "EX", 10)
    assert s("TTL", "a") == 10 and s("PTTL", "a") == 10_000 and s("EXPIRE", "a", 5, "GT") == 0 and s("EXPIRE", "a", 50, "GT") == 1 and s("TTL", "a") == 50
    assert s("PERSIST", "a") == 1 and s("TTL", "a") == -1 and s("TTL", "none") == -2 and s("EXPIRE", "a", -1) == 1 and s("EXISTS", "a") == 0


def test_hashes_and_lists(spark):
    s = Session(spark)
    assert s("HSET", "h", "f", "1", "g", "2") == 2 and s("HSET", "h", "f", "3") == 0 and s("HINCRBY", "h", "g", 5) == 7 and s("HGETALL", "h") == [("f", "3"), ("g", "7")]
    assert s("HDEL", "h", "f", "g", "x") == 2 and s("EXISTS", "h") == 0
    assert s("RPUSH", "l", "a", "b", "c", "b") == 4 and s("LPUSH", "l", "z") == 5 and s("LRANGE", "l", 0, -1) == [(0, "z"), (1, "a"), (2, "b"), (3, "c"), (4, "b")]
    assert s("LPOS", "l", "b", "RANK", -1) == [(1, 4)] and s("LPOS", "l", "b", "COUNT", 0) == [(1, 2), (2, 4)] and s("LREM", "l", -1, "b") == 1 and s("LINSERT", "l", "BEFORE", "c", "n") == 5
    assert s("LINDEX", "l", -2) == "n" and s("LSET", "l", 0, "y") == "OK" and s("LMOVE", "l", "m", "LEFT", "RIGHT") == "y" and s("LTRIM", "l", 1, -1) == "OK" and s("LLEN", "l") == 3
    assert s("RPOP", "l") == [(0, "c")] and s("LPUSHX", "none", "x") == 0


def test_sets(spark):
    s = Session(spark)
    assert s("SADD", "a", "1", "2", "3", "3") == 3 and s("SADD", "b", "2", "3", "4") == 3
    assert sorted(s("SINTER", "a", "b")) == [("2",), ("3",)] and s("SDIFF", "a", "b") == "1" and s("SUNIONSTORE", "c", "a", "b") == 4 and s("SINTERCARD", 2, "a", "b", "LIMIT", 1) == 1
    assert s("SMOVE", "a", "b", "1") == 1 and s("SMISMEMBER", "b", "1", "9") == [(0, "1", 1), (1, "9", 0)] and len(s("SRANDMEMBER", "b", -6)) == 6 and s("SREM", "a", "2", "3") == 2 and s("EXISTS", "a") == 0
    assert s("RENAME", "b", "d") == "OK" and s("SCARD", "d") == 4 and s("MOVE", "d", 1) == 1 and s("DBSIZE") == 1


def test_zsets(spark):
    s = Session(spark)
    assert s("ZADD", "z", 1, "a", 2, "b", 3, "c") == 3 and s("ZADD", "z", "XX", "CH", "GT", 0, "a", 5, "b", 9, "new") == 1
    assert s("ZRANGE", "z", 0, -1) == [("a", 1.0), ("c", 3.0), ("b", 5.0)] and s("ZREVRANK", "z", "b") == 0 and s("ZRANK", "z", "none") == []
    assert s("ZRANGEBYSCORE", "z", "(1", "+inf", "LIMIT", 0, 1) == [("c", 3.0)] and s("ZRANGE", "z", "+", "(a", "BYLEX", "REV") == [("b", 5.0), ("c", 3.0)]
    assert s("ZINCRBY", "z", 2, "a") == 3.0 and s("ZPOPMAX", "z") == [(0, "b", 5.0)] and s("ZCOUNT", "z", 3, 3) == 2
    s("SADD", "s", "a", "q")
    assert s("ZUNION", 2, "z", "s", "WEIGHTS", 1, 10) == [("c", 3.0), ("q", 10.0), ("a", 13.0)] and s("ZINTER", 2, "z", "s") == [("a", 4.0)] and s("ZDIFF", 2, "z", "s") == [("c", 3.0)]
    assert s("ZADD", "i", "inf", "m") == 1 and s("ZADD", "j", "-inf", "m") == 1 and s("ZUNION", 2, "i", "j") == [("m", 0.0)]
    assert s("ZREMRANGEBYRANK", "z", 0, 0) == 1 and s("ZCARD", "z") == 1


def test_geo(spark):
    s = Session(spark)
    assert s("GEOADD", "g", 13.361389, 38.115556, "Palermo", 15.087269, 37.502669, "Catania") == 2
    assert s("ZSCORE", "g", "Palermo") == 3479099956230698.0 and s("GEODIST", "g", "Palermo", "Catania") == 166274.1516 and s("GEODIST", "g", "Palermo", "Catania", "km") == 166.2742
    assert s("GEOHASH", "g", "Palermo", "Catania") == [(0, "Palermo", "sqc8b49rny0"), (1, "Catania", "sqdtr74hyu0")]
    assert [r[0] for r in s("GEOSEARCH", "g", "FROMLONLAT", 15, 37, "BYRADIUS", 200, "km", "ASC")] == ["Catania", "Palermo"] and s("GEORADIUS", "g", 15, 37, 100, "km")[0][0] == "Catania"
    assert s("GEOSEARCHSTORE", "h", "g", "FROMMEMBER", "Palermo", "BYBOX", 400, 400, "km") == 2


def test_scan_and_glob(spark):
    s = Session(spark)
    s("MSET", *[x for i in range(25) for x in (f"k{i:02}", "v")])
    first = s("SCAN", None, "COUNT", 10)
    assert len(first) == 10 and len(s("SCAN", first[-1][0], "COUNT", 100)) == 15 and sorted(s("KEYS", "k[01]3")) == [("k03",), ("k13",)]
    for pattern, yes, no in (("h?llo", "hello", "hllo"), ("h[^e]llo", "hallo", "hello"), ("h[a-b]llo", "hbllo", "hcllo"), (r"a\*b", "a*b", "axb"), ("*.x", "a\n.x", "ax")):
        assert re.search(glob_regex(pattern), yes) and not re.search(glob_regex(pattern), no)
