"""List commands. Positions are counted from 0 by a window over each key's index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.operators.kv.base import NO_KEY, KeySpace, Written, fail, integer, span
from tessera.operators.kv.keys import options_of


def placed(rows: DataFrame, by: str | None = None) -> DataFrame:
    """``rows`` (with ``idx``) and their position and number, each key by itself if ``by`` names one."""
    keyed = rows if by else rows.withColumn("__one", F.lit(0))
    w = Window.partitionBy(by or "__one")
    out = keyed.withColumn("pos", (F.row_number().over(w.orderBy("idx")) - 1).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(w))
    return out if by else out.drop("__one")


def ranges(rows: DataFrame, start: int, stop: int, by: str | None = None) -> DataFrame:
    """The elements between two positions, both counted."""
    at = placed(rows, by)
    lo, hi = span(start, stop, F.col("n"))
    return at.where((F.col("pos") >= lo) & (F.col("pos") <= hi))


def _ends(rows: DataFrame) -> tuple[int, int]:
    row = rows.agg(F.min("idx"), F.max("idx")).first()
    return (row[0], row[1]) if row[0] is not None else (0, -1)


def _push(left: bool, only_there: bool):
    def run(s: KeySpace, key: str, *values: str) -> Written:
        if not values:
            raise fail("wrong number of arguments for push")
        rows = s.elements("list", key).select("idx", "value")
        if only_there and s.type_of(key) is None:
            return Written(s, s.value(0))
        lo, hi = _ends(rows)
        new = s.spark.createDataFrame([(lo - 1 - i if left else hi + 1 + i, v) for i, v in enumerate(values)], "idx bigint, value string")
        out = rows.unionByName(new)
        return Written(s.put("list", key, out), out.agg(F.count(F.lit(1)).alias("reply")))

    return run


lpush, rpush, lpushx, rpushx = _push(True, False), _push(False, False), _push(True, True), _push(False, True)


def _pop(left: bool):
    def run(s: KeySpace, key: str, count: object = None) -> Written:
        n = 1 if count is None else integer(count)
        if n < 0:
            raise fail("value is out of range, must be positive")
        at = placed(s.elements("list", key).select("idx", "value"))
        back = F.col("pos") if left else F.col("n") - 1 - F.col("pos")
        reply = at.where(back < n).select(back.alias("at"), "value").orderBy("at")
        return Written(s.put("list", key, at.where(back >= n).select("idx", "value")), reply)

    return run


lpop, rpop = _pop(True), _pop(False)


def llen(s: KeySpace, key: str) -> DataFrame:
    return s.elements("list", key).agg(F.count(F.lit(1)).alias("reply"))


def lrange(s: KeySpace, key: str, start: object, stop: object) -> DataFrame:
    return ranges(s.elements("list", key), integer(start), integer(stop)).orderBy("pos").select("pos", "value")


def lindex(s: KeySpace, key: str, index: object) -> DataFrame:
    i = integer(index)
    at = placed(s.elements("list", key))
    return at.where(F.col("pos") == (F.lit(i) if i >= 0 else F.col("n") + i)).select(F.col("value").alias("reply"))


def lset(s: KeySpace, key: str, index: object, value: str) -> Written:
    i = integer(index)
    if s.check(key, "list") is None:
        raise QueryError(0, NO_KEY)
    at = placed(s.elements("list", key).select("idx", "value"))
    hit = F.col("pos") == (F.lit(i) if i >= 0 else F.col("n") + i)
    if at.where(hit).isEmpty():
        raise fail("index out of range")
    return Written(s.put("list", key, at.select("idx", F.when(hit, F.lit(value)).otherwise(F.col("value")).alias("value"))), s.value("OK", "string"))


def removed(rows: DataFrame, value: Column, count: int, by: str | None = None) -> DataFrame:
    """Lists without the first ``count`` elements that equal a value; the last ones if it is negative, all if it is 0."""
    keyed = rows if by else rows.withColumn("__one", F.lit(0))
    w = Window.partitionBy(by or "__one", F.col("value") == value).orderBy(F.desc("idx") if count < 0 else F.asc("idx"))
    out = keyed.withColumn("__nth", F.row_number().over(w))
    gone = F.coalesce(F.col("value") == value, F.lit(False)) & ((F.col("__nth") <= abs(count)) if count else F.lit(True))
    return out.where(~gone).drop("__nth", "__one")


def lrem(s: KeySpace, key: str, count: object, value: str) -> Written:
    rows = s.elements("list", key).select("idx", "value")
    left = removed(rows, F.lit(value), integer(count))
    before, after = rows.agg(F.count(F.lit(1)).alias("a")), left.agg(F.count(F.lit(1)).alias("b"))
    return Written(s.put("list", key, left), s.value(before.first()[0] - after.first()[0]))


def ltrim(s: KeySpace, key: str, start: object, stop: object) -> Written:
    rows = ranges(s.elements("list", key).select("idx", "value"), integer(start), integer(stop))
    return Written(s.put("list", key, rows.select("idx", "value")), s.value("OK", "string"))


def linsert(s: KeySpace, key: str, where: str, pivot: str, value: str) -> Written:
    if where.upper() not in ("BEFORE", "AFTER"):
        raise fail("syntax error")
    rows = s.elements("list", key).select("idx", "value")
    if s.type_of(key) is None:
        return Written(s, s.value(0))
    at = rows.where(F.col("value") == pivot).agg(F.min("idx")).first()[0]
    if at is None:
        return Written(s, s.value(-1))
    cut = at if where.upper() == "BEFORE" else at + 1
    shifted = rows.select(F.when(F.col("idx") >= cut, F.col("idx") + 1).otherwise(F.col("idx")).alias("idx"), "value")
    out = shifted.unionByName(s.spark.createDataFrame([(cut, value)], "idx bigint, value string"))
    return Written(s.put("list", key, out), out.agg(F.count(F.lit(1)).alias("reply")))


def positions(rows: DataFrame, value: str, rank: int = 1, count: int | None = None, most: int = 0, by: str | None = None) -> DataFrame:
    """``pos`` of the elements that equal a value, from the ``rank``-th on (from the end if negative), ``count`` of
    them (0: all, None: one), among the first ``most`` elements looked at (0: all)."""
    at = placed(rows, by)
    back = F.col("pos") if rank > 0 else F.col("n") - 1 - F.col("pos")
    hits = at.where((F.col("value") == value) & (back < most if most else F.lit(True)))
    keyed = hits if by else hits.withColumn("__one", F.lit(0))
    nth = F.row_number().over(Window.partitionBy(by or "__one").orderBy(back))
    out = keyed.withColumn("nth", nth - abs(rank) + 1).where("nth >= 1")
    n = 1 if count is None else count
    return (out.where(F.col("nth") <= n) if n else out).drop("__one")


def lpos(s: KeySpace, key: str, value: str, *args: object) -> DataFrame:
    o = options_of(args, {"RANK": 1, "COUNT": 1, "MAXLEN": 1})
    rank, count, most = integer(o.get("RANK", [1])[0]), (integer(o["COUNT"][0]) if "COUNT" in o else None), integer(o.get("MAXLEN", [0])[0])
    if rank == 0:
        raise fail("RANK can't be zero: use 1 to start from the first match, 2 from the second ... or use negative to start from the end of the list")
    if count is not None and count < 0 or most < 0:
        raise fail("COUNT can't be negative" if most >= 0 else "MAXLEN can't be negative")
    return positions(s.elements("list", key), value, rank, count, most).orderBy("nth").select("nth", "pos")


def lmove(s: KeySpace, src: str, dst: str, take: str, give: str) -> Written:
    if take.upper() not in ("LEFT", "RIGHT") or give.upper() not in ("LEFT", "RIGHT"):
        raise fail("syntax error")
    s.check(dst, "list")
    popped = (lpop if take.upper() == "LEFT" else rpop)(s, src)
    row = popped.reply.first()
    if row is None:
        return Written(s, s.value(None, "string"))
    pushed = (lpush if give.upper() == "LEFT" else rpush)(popped.space, dst, row["value"])
    return Written(pushed.space, s.value(row["value"], "string"))


def rpoplpush(s: KeySpace, src: str, dst: str) -> Written:
    return lmove(s, src, dst, "RIGHT", "LEFT")
