"""Commands on keys of any type: existence, renaming, expiry, scanning."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.operators.kv.base import NO_KEY, SCHEMAS, KeySpace, Written, fail, integer, matches


def delete(s: KeySpace, *keys: str) -> Written:
    hit = s.live().where(F.col("key").isin(*keys)).agg(F.count(F.lit(1)).alias("reply"))
    return Written(s.without(*keys), hit)


def exists(s: KeySpace, *keys: str) -> DataFrame:
    """How many of the keys live; a key given twice counts twice."""
    return s.ordered(list(keys), "key").join(s.live().select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("reply"))


def type_(s: KeySpace, key: str) -> DataFrame:
    return s.ordered([key], "key").join(s.live().select("key", "type"), "key", "left").select(F.coalesce("type", F.lit("none")).alias("reply"))


def rename(s: KeySpace, src: str, dst: str) -> Written:
    if s.type_of(src) is None:
        raise QueryError(0, NO_KEY)
    base = s if src == dst else s.without(dst)
    moved = {n: getattr(base, n).withColumn("key", F.when(s.here(src), F.lit(dst)).otherwise(F.col("key"))) for n in SCHEMAS}
    return Written(replace(base, **moved), s.value("OK", "string"))


def renamenx(s: KeySpace, src: str, dst: str) -> Written:
    if s.type_of(src) is None:
        raise QueryError(0, NO_KEY)
    if s.type_of(dst) is not None:
        return Written(s, s.value(0))
    return Written(rename(s, src, dst).space, s.value(1))


def keys(s: KeySpace, pattern: str) -> DataFrame:
    return s.live().where(matches(F.col("key"), pattern)).select("key")


def randomkey(s: KeySpace, seed: int = 0) -> DataFrame:
    return s.live().orderBy(F.rand(seed)).limit(1).select("key")


def move(s: KeySpace, key: str, db: object) -> Written:
    to = integer(db)
    other = replace(s, db=to)
    if to == s.db:
        raise fail("source and destination objects are the same")
    if s.type_of(key) is None or other.type_of(key) is not None:
        return Written(s, s.value(0))
    base = replace(other.without(key), db=s.db)
    moved = {n: getattr(base, n).withColumn("db", F.when(s.here(key), F.lit(to)).otherwise(F.col("db"))) for n in SCHEMAS}
    return Written(replace(base, **moved), s.value(1))


def dbsize(s: KeySpace) -> DataFrame:
    return s.live().agg(F.count(F.lit(1)).alias("reply"))


def flushdb(s: KeySpace, *_: str) -> Written:
    return Written(replace(s, **{n: getattr(s, n).where(F.col("db") != s.db) for n in SCHEMAS}), s.value("OK", "string"))


def flushall(s: KeySpace, *_: str) -> Written:
    return Written(replace(s, **{n: getattr(s, n).limit(0) for n in SCHEMAS}), s.value("OK", "string"))


def _expire(scale: int, absolute: bool):
    def run(s: KeySpace, key: str, amount: object, *options: str) -> Written:
        flags = {o.upper() for o in options}
        if unknown := flags - {"NX", "XX", "GT", "LT"}:
            raise fail(f"Unsupported option {next(iter(unknown))}")
        if "NX" in flags and len(flags) > 1:
            raise fail("NX and XX, GT or LT options at the same time are not compatible")
        if {"GT", "LT"} <= flags:
            raise fail("GT and LT options at the same time are not compatible")
        when = integer(amount) * scale + (0 if absolute else s.now_ms)
        row = s.live().where(F.col("key") == key).select("expire_ms").first()
        if row is None:
            return Written(s, s.value(0))
        old = row[0]
        refused = ("NX" in flags and old) or ("XX" in flags and not old) or ("GT" in flags and (not old or when <= old)) or ("LT" in flags and old and when >= old)
        if refused:
            return Written(s, s.value(0))
        return Written(s.without(key) if when <= s.now_ms else s.expiring(key, when), s.value(1))

    return run


expire, pexpire, expireat, pexpireat = _expire(1000, False), _expire(1, False), _expire(1000, True), _expire(1, True)


def time_left(s: KeySpace, scale: int, absolute: bool) -> Column:
    """Of a key row, null if the key is missing: -2 if so, -1 without expiry, else what is left, rounded."""
    e = F.col("expire_ms")
    left = e if absolute else F.greatest(e - s.now_ms, F.lit(0))
    return F.when(e.isNull(), F.lit(-2)).when(e == 0, F.lit(-1)).otherwise(F.floor((left + scale // 2) / scale)).cast("bigint")


def _left(scale: int, absolute: bool):
    def run(s: KeySpace, key: str) -> DataFrame:
        return s.ordered([key], "key").join(s.live().select("key", "expire_ms"), "key", "left").select(time_left(s, scale, absolute).alias("reply"))

    return run


ttl, pttl, expiretime, pexpiretime = _left(1000, False), _left(1, False), _left(1000, True), _left(1, True)


def persist(s: KeySpace, key: str) -> Written:
    row = s.live().where((F.col("key") == key) & (F.col("expire_ms") != 0)).first()
    return Written(s.expiring(key, 0) if row else s, s.value(int(row is not None)))


def options_of(args: tuple, known: dict[str, int]) -> dict[str, list[object]]:
    """Options by name with their arguments."""
    out: dict[str, list[object]] = {}
    i = 0
    while i < len(args):
        name = str(args[i]).upper()
        if name not in known or i + known[name] >= len(args):
            raise fail("syntax error")
        out[name] = list(args[i + 1 : i + 1 + known[name]])
        i += 1 + known[name]
    return out


def page(rows: DataFrame, by: str, cursor: str | None, args: tuple, more: dict[str, int] | None = None) -> tuple[DataFrame, dict]:
    """The next rows after a cursor, the last value seen; None from the start. Pages of COUNT rows, 10 unless told."""
    o = options_of(args, {"MATCH": 1, "COUNT": 1} | (more or {}))
    n = integer(o.get("COUNT", [10])[0])
    if n < 1:
        raise fail("syntax error")
    after = rows if cursor in (None, "", "0") else rows.where(F.col(by) > cursor)
    return after.orderBy(by).limit(n).where(matches(F.col(by), o["MATCH"][0] if "MATCH" in o else None)), o


def scan(s: KeySpace, cursor: str | None = None, *args: object) -> DataFrame:
    rows, o = page(s.live().select("key", "type"), "key", cursor, args, {"TYPE": 1})
    return (rows.where(F.col("type") == str(o["TYPE"][0]).lower()) if "TYPE" in o else rows).select("key")


def hscan(s: KeySpace, key: str, cursor: str | None = None, *args: object) -> DataFrame:
    bare = any(str(a).upper() == "NOVALUES" for a in args)
    rows, _ = page(s.elements("hash", key), "field", cursor, tuple(a for a in args if str(a).upper() != "NOVALUES"))
    return rows.select("field") if bare else rows.select("field", "value")


def sscan(s: KeySpace, key: str, cursor: str | None = None, *args: object) -> DataFrame:
    return page(s.elements("set", key), "member", cursor, args)[0].select("member")


def zscan(s: KeySpace, key: str, cursor: str | None = None, *args: object) -> DataFrame:
    return page(s.elements("zset", key), "member", cursor, args)[0].select("member", "score")


def keystats(s: KeySpace) -> DataFrame:
    """By type: live keys, and how many of them expire."""
    return s.live().groupBy("type").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("expire_ms") != 0).alias("expiring"))
