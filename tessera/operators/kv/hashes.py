"""Hash commands. Fields and values come in the fields' order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.kv.base import KeySpace, Written, fail, integer
from tessera.operators.kv.strings import _pairs, added


def _upsert(s: KeySpace, key: str, pairs: dict[str, str]) -> KeySpace:
    old = s.elements("hash", key)
    new = s.spark.createDataFrame(list(pairs.items()), "field string, value string")
    return s.put("hash", key, old.join(new, "field", "left_anti").unionByName(new))


def hset(s: KeySpace, key: str, *args: str) -> Written:
    pairs = _pairs(args, "hset")
    old = s.elements("hash", key).where(F.col("field").isin(*pairs)).agg((F.lit(len(pairs)) - F.count(F.lit(1))).alias("reply"))
    return Written(_upsert(s, key, pairs), old)


def hmset(s: KeySpace, key: str, *args: str) -> Written:
    return Written(hset(s, key, *args).space, s.value("OK", "string"))


def hsetnx(s: KeySpace, key: str, field: str, value: str) -> Written:
    if not s.elements("hash", key).where(F.col("field") == field).isEmpty():
        return Written(s, s.value(0))
    return Written(_upsert(s, key, {field: value}), s.value(1))


def hget(s: KeySpace, key: str, field: str) -> DataFrame:
    return hmget(s, key, field).select(F.col("value").alias("reply"))


def hmget(s: KeySpace, key: str, *fields: str) -> DataFrame:
    return s.ordered(list(fields), "field").join(s.elements("hash", key), "field", "left").orderBy("at").select("at", "field", "value")


def hdel(s: KeySpace, key: str, *fields: str) -> Written:
    rows = s.elements("hash", key)
    hit = rows.where(F.col("field").isin(*fields)).agg(F.count(F.lit(1)).alias("reply"))
    return Written(s.put("hash", key, rows.where(~F.col("field").isin(*fields))), hit)


def hlen(s: KeySpace, key: str) -> DataFrame:
    return s.elements("hash", key).agg(F.count(F.lit(1)).alias("reply"))


def hexists(s: KeySpace, key: str, field: str) -> DataFrame:
    return s.elements("hash", key).where(F.col("field") == field).agg(F.count(F.lit(1)).alias("reply"))


def hstrlen(s: KeySpace, key: str, field: str) -> DataFrame:
    return hget(s, key, field).select(F.coalesce(F.octet_length("reply"), F.lit(0)).cast("bigint").alias("reply"))


def hkeys(s: KeySpace, key: str) -> DataFrame:
    return s.elements("hash", key).select("field").orderBy("field")


def hvals(s: KeySpace, key: str) -> DataFrame:
    return s.elements("hash", key).orderBy("field").select("value")


def hgetall(s: KeySpace, key: str) -> DataFrame:
    return s.elements("hash", key).orderBy("field").select("field", "value")


def maps(s: KeySpace) -> DataFrame:
    """``key`` and ``fields``, a map, of every live hash, in one plan."""
    pairs = F.sort_array(F.collect_list(F.struct("field", "value")))
    return s.all_elements("hash").groupBy("key").agg(F.map_from_entries(pairs).alias("fields"))


def hincrby(s: KeySpace, key: str, field: str, n: object) -> Written:
    row = s.elements("hash", key).where(F.col("field") == field).first()
    try:
        old = integer(row["value"]) if row else 0
    except ValueError as e:
        raise fail("hash value is not an integer") from e
    new = old + integer(n)
    if not -(1 << 63) <= new < 1 << 63:
        raise fail("increment or decrement would overflow")
    return Written(_upsert(s, key, {field: str(new)}), s.value(new))


def hincrbyfloat(s: KeySpace, key: str, field: str, by: object) -> Written:
    row = s.elements("hash", key).where(F.col("field") == field).first()
    new = added(row["value"] if row else None, by)
    return Written(_upsert(s, key, {field: new}), s.value(new, "string"))


def sampled(rows: DataFrame, count: int | None, seed: int) -> DataFrame:
    """Distinct rows for a count of 0 or more, rows with replacement for a negative one, one row without a count."""
    if count is None or count >= 0:
        return rows.orderBy(F.rand(seed)).limit(1 if count is None else count)
    # each draw takes the row whose place is a random number below the number of rows
    n = rows.count()
    if not n:
        return rows
    placed = rows.withColumn("__place", F.row_number().over(Window.orderBy(*rows.columns)) - 1)
    draws = rows.sparkSession.range(-count).select(F.floor(F.rand(seed) * n).cast("int").alias("__place"))
    return draws.join(placed, "__place").drop("__place")




def hrandfield(s: KeySpace, key: str, count: object = None, values: str | None = None, seed: int = 0) -> DataFrame:
    if values is not None and values.upper() != "WITHVALUES":
        raise fail("syntax error")
    rows = s.elements("hash", key).select("field", "value")
    return sampled(rows if values else rows.select("field"), None if count is None else integer(count), seed)
