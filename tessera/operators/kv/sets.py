"""Set commands and set algebra, always with distinct members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.kv.base import KeySpace, Written, fail, integer
from tessera.operators.kv.hashes import sampled


def members(s: KeySpace, key: str) -> DataFrame:
    return s.elements("set", key).select("member")


def sadd(s: KeySpace, key: str, *new: str) -> Written:
    rows = members(s, key)
    fresh = s.spark.createDataFrame([(m,) for m in dict.fromkeys(new)], "member string").join(rows, "member", "left_anti")
    return Written(s.put("set", key, rows.unionByName(fresh)), fresh.agg(F.count(F.lit(1)).alias("reply")))


def srem(s: KeySpace, key: str, *old: str) -> Written:
    rows = members(s, key)
    hit = rows.where(F.col("member").isin(*old)).agg(F.count(F.lit(1)).alias("reply"))
    return Written(s.put("set", key, rows.where(~F.col("member").isin(*old))), hit)


def smembers(s: KeySpace, key: str) -> DataFrame:
    return members(s, key).orderBy("member")


def sismember(s: KeySpace, key: str, member: str) -> DataFrame:
    return members(s, key).where(F.col("member") == member).agg(F.count(F.lit(1)).alias("reply"))


def smismember(s: KeySpace, key: str, *ms: str) -> DataFrame:
    return s.ordered(list(ms), "member").join(members(s, key).withColumn("there", F.lit(1)), "member", "left").orderBy("at").select("at", "member", F.coalesce("there", F.lit(0)).alias("there"))


def scard(s: KeySpace, key: str) -> DataFrame:
    return members(s, key).agg(F.count(F.lit(1)).alias("reply"))


def spop(s: KeySpace, key: str, count: object = None, seed: int = 0) -> Written:
    n = 1 if count is None else integer(count)
    if n < 0:
        raise fail("value is out of range, must be positive")
    rows = members(s, key)
    popped = rows.orderBy(F.xxhash64("member", F.lit(seed)), "member").limit(n)
    return Written(s.put("set", key, rows.join(popped, "member", "left_anti")), popped)


def srandmember(s: KeySpace, key: str, count: object = None, seed: int = 0) -> DataFrame:
    return sampled(members(s, key), None if count is None else integer(count), seed)


def smove(s: KeySpace, src: str, dst: str, member: str) -> Written:
    s.check(dst, "set")
    if members(s, src).where(F.col("member") == member).isEmpty():
        return Written(s, s.value(0))
    if src == dst:
        return Written(s, s.value(1))
    return Written(sadd(srem(s, src, member).space, dst, member).space, s.value(1))


def intersection(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "member", "left_semi"), sets)


def union(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def difference(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "member", "left_anti"), sets)


def _read(combine):
    def run(s: KeySpace, *keys: str) -> DataFrame:
        return combine([members(s, k) for k in keys])

    return run


sinter, sunion, sdiff = _read(intersection), _read(union), _read(difference)


def _store(read):
    def run(s: KeySpace, dst: str, *keys: str) -> Written:
        rows = read(s, *keys)
        return Written(s.put("set", dst, rows, 0), rows.agg(F.count(F.lit(1)).alias("reply")))

    return run


sinterstore, sunionstore, sdiffstore = _store(sinter), _store(sunion), _store(sdiff)


def keys_and_limit(args: tuple) -> tuple[list[str], int]:
    """A number of keys, the keys, and an optional LIMIT, 0 being none."""
    n = integer(args[0]) if args else 0
    if n <= 0:
        raise fail("numkeys should be greater than 0")
    if len(args) < n + 1:
        raise fail("Number of keys can't be greater than number of args")
    rest = args[n + 1 :]
    if rest and (len(rest) != 2 or str(rest[0]).upper() != "LIMIT"):
        raise fail("syntax error")
    most = integer(rest[1]) if rest else 0
    if most < 0:
        raise fail("LIMIT can't be negative")
    return list(args[1 : n + 1]), most


def sintercard(s: KeySpace, *args: object) -> DataFrame:
    keys, most = keys_and_limit(args)
    rows = sinter(s, *keys)
    return (rows.limit(most) if most else rows).agg(F.count(F.lit(1)).alias("reply"))
