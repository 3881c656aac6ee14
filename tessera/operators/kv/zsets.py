"""Scored sets: ranks are windows over score and member, algebra is a group by member."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.kv.base import KeySpace, Written, fail, integer, number, span
from tessera.operators.kv.hashes import sampled
from tessera.operators.kv.sets import keys_and_limit


def scored(s: KeySpace, key: str) -> DataFrame:
    return s.elements("zset", key).select("member", "score")


def ranked(rows: DataFrame, reverse: bool = False, by: str | None = None) -> DataFrame:
    """``rows`` with ``rank`` from 0 and ``n``, each key by itself if ``by`` names one."""
    keyed = rows if by else rows.withColumn("__one", F.lit(0))
    w = Window.partitionBy(by or "__one")
    order = [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]
    out = keyed.withColumn("rank", (F.row_number().over(w.orderBy(*order)) - 1).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(w))
    return out if by else out.drop("__one")


# ---- bounds


def score_bounds(low: object, high: object) -> Column:
    """Scores between two bounds; one that begins with ``(`` is left out itself."""
    out = F.lit(True)
    for text, up in ((str(low), True), (str(high), False)):
        try:
            x, open_ = number(text.removeprefix("(")), text.startswith("(")
        except ValueError as e:
            raise fail("min or max is not a float") from e
        c = F.col("score")
        out = out & ((c > x if open_ else c >= x) if up else (c < x if open_ else c <= x))
    return out


def lex_bounds(low: str, high: str) -> Column:
    """Members between two bounds: ``-``, ``+``, ``[x`` with x, ``(x`` without it."""
    out = F.lit(True)
    for text, up in ((low, True), (high, False)):
        if text in ("-", "+"):
            out = out & F.lit((text == "-") == up)
        elif text[:1] in ("[", "("):
            c, x = F.col("member"), text[1:]
            out = out & ((c > x if text[0] == "(" else c >= x) if up else (c < x if text[0] == "(" else c <= x))
        else:
            raise fail("min or max not valid string range item")
    return out


# ---- single sets


def zadd(s: KeySpace, key: str, *args: object) -> Written:
    flags, i = set(), 0
    while i < len(args) and str(args[i]).upper() in ("NX", "XX", "GT", "LT", "CH", "INCR"):
        flags.add(str(args[i]).upper())
        i += 1
    rest = args[i:]
    if not rest or len(rest) % 2:
        raise fail("syntax error")
    if "NX" in flags and "XX" in flags:
        raise fail("XX and NX options at the same time are not compatible")
    if len(flags & {"GT", "LT", "NX"}) > 1:
        raise fail("GT, LT, and/or NX options at the same time are not compatible")
    pairs = [(str(m), number(x)) for x, m in zip(rest[::2], rest[1::2])]
    if "INCR" in flags and len(pairs) > 1:
        raise fail("INCR option supports a single increment-element pair")
    old = scored(s, key)
    names = [m for m, _ in pairs]
    now = {r["member"]: r["score"] for r in old.where(F.col("member").isin(*names)).collect()}
    before, added, moved, last = dict(now), 0, 0, None
    for m, x in pairs:
        there = m in now
        if "NX" in flags and there or "XX" in flags and not there:
            continue
        new = now[m] + x if "INCR" in flags and there else x
        if new != new:
            raise fail("resulting score is not a number (NaN)")
        if there and ("GT" in flags and new <= now[m] or "LT" in flags and new >= now[m]):
            continue
        added, moved = added + (not there), moved + (there and new != now[m])
        now[m] = last = new
    if now == before:
        return Written(s, s.value(last, "double") if "INCR" in flags else s.value(0))
    new = s.spark.createDataFrame(list(now.items()), "member string, score double")
    out = old.join(new.select("member"), "member", "left_anti").unionByName(new)
    reply = s.value(last, "double") if "INCR" in flags else s.value(added + moved if "CH" in flags else added)
    return Written(s.put("zset", key, out), reply)


def zincrby(s: KeySpace, key: str, by: object, member: str) -> Written:
    return zadd(s, key, "INCR", by, member)


def _without(s: KeySpace, key: str, rows: DataFrame, gone: Column) -> Written:
    gone = F.coalesce(gone, F.lit(False))
    return Written(s.put("zset", key, rows.where(~gone).select("member", "score")), rows.where(gone).agg(F.count(F.lit(1)).alias("reply")))


def zrem(s: KeySpace, key: str, *members: str) -> Written:
    return _without(s, key, scored(s, key), F.col("member").isin(*members))


def zscore(s: KeySpace, key: str, member: str) -> DataFrame:
    return zmscore(s, key, member).select(F.col("score").alias("reply"))


def zmscore(s: KeySpace, key: str, *members: str) -> DataFrame:
    return s.ordered(list(members), "member").join(scored(s, key), "member", "left").orderBy("at").select("at", "member", "score")


def zcard(s: KeySpace, key: str) -> DataFrame:
    return scored(s, key).agg(F.count(F.lit(1)).alias("reply"))


def zcount(s: KeySpace, key: str, low: object, high: object) -> DataFrame:
    return scored(s, key).where(score_bounds(low, high)).agg(F.count(F.lit(1)).alias("reply"))


def zlexcount(s: KeySpace, key: str, low: str, high: str) -> DataFrame:
    return scored(s, key).where(lex_bounds(low, high)).agg(F.count(F.lit(1)).alias("reply"))


def rank_range(rows: DataFrame, start: int, stop: int, reverse: bool = False, by: str | None = None) -> DataFrame:
    at = ranked(rows, reverse, by)
    lo, hi = span(start, stop, F.col("n"))
    return at.where((F.col("rank") >= lo) & (F.col("rank") <= hi))


def _select(rows: DataFrame, how: str, a: object, b: object, reverse: bool, limit: tuple[int, int] | None) -> DataFrame:
    order = [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]
    if how == "rank":
        if limit:
            raise fail("syntax error, LIMIT is only supported in combination with either BYSCORE or BYLEX")
        return rank_range(rows, integer(a), integer(b), reverse).orderBy("rank").select("member", "score")
    low, high = (b, a) if reverse else (a, b)
    out = rows.where(score_bounds(low, high) if how == "score" else lex_bounds(str(low), str(high))).orderBy(*order)
    if limit:
        skip, n = limit
        if skip < 0:
            return out.limit(0)
        out = out.offset(skip) if skip else out
        out = out.limit(n) if n >= 0 else out
    return out.select("member", "score")


def _range(how: str | None, reverse: bool | None):
    """A range command; None: told by options."""

    def run(s: KeySpace, key: str, a: object, b: object, *args: object) -> DataFrame:
        by, back, limit, with_scores = how or "rank", bool(reverse), None, False
        i = 0
        while i < len(args):
            o = str(args[i]).upper()
            if how is None and o in ("BYSCORE", "BYLEX"):
                by = {"BYSCORE": "score", "BYLEX": "lex"}[o]
            elif how is None and o == "REV":
                back = True
            elif o == "LIMIT" and i + 2 < len(args):
                limit, i = (integer(args[i + 1]), integer(args[i + 2])), i + 2
            elif o == "WITHSCORES":
                with_scores = True
            else:
                raise fail("syntax error")
            i += 1
        if with_scores and by == "lex":
            raise fail("syntax error, WITHSCORES not supported in combination with BYLEX")
        return _select(scored(s, key), by, a, b, back, limit)

    return run


zrange, zrevrange = _range(None, None), _range("rank", True)
zrangebyscore, zrevrangebyscore = _range("score", False), _range("score", True)
zrangebylex, zrevrangebylex = _range("lex", False), _range("lex", True)


def zrangestore(s: KeySpace, dst: str, src: str, a: object, b: object, *args: object) -> Written:
    rows = zrange(s, src, a, b, *args)
    return Written(s.put("zset", dst, rows, 0), rows.agg(F.count(F.lit(1)).alias("reply")))


def _rank(reverse: bool):
    def run(s: KeySpace, key: str, member: str, with_score: str | None = None) -> DataFrame:
        if with_score is not None and with_score.upper() != "WITHSCORE":
            raise fail("syntax error")
        row = ranked(scored(s, key), reverse).where(F.col("member") == member)
        return row.select(F.col("rank").alias("reply"), *(["score"] if with_score else []))

    return run


zrank, zrevrank = _rank(False), _rank(True)


def _pop(reverse: bool):
    def run(s: KeySpace, key: str, count: object = 1) -> Written:
        n = integer(count)
        if n < 0:
            raise fail("value is out of range, must be positive")
        at = ranked(scored(s, key), reverse)
        reply = at.where(F.col("rank") < n).orderBy("rank").select("rank", "member", "score")
        return Written(s.put("zset", key, at.where(F.col("rank") >= n).select("member", "score")), reply)

    return run


zpopmin, zpopmax = _pop(False), _pop(True)


def zrandmember(s: KeySpace, key: str, count: object = None, scores: str | None = None, seed: int = 0) -> DataFrame:
    if scores is not None and scores.upper() != "WITHSCORES":
        raise fail("syntax error")
    rows = scored(s, key)
    return sampled(rows if scores else rows.select("member"), None if count is None else integer(count), seed)


def zremrangebyrank(s: KeySpace, key: str, start: object, stop: object) -> Written:
    at = ranked(scored(s, key))
    lo, hi = span(integer(start), integer(stop), F.col("n"))
    return _without(s, key, at, (F.col("rank") >= lo) & (F.col("rank") <= hi))


def zremrangebyscore(s: KeySpace, key: str, low: object, high: object) -> Written:
    return _without(s, key, scored(s, key), score_bounds(low, high))


def zremrangebylex(s: KeySpace, key: str, low: str, high: str) -> Written:
    return _without(s, key, scored(s, key), lex_bounds(low, high))


# ---- algebra


def operand(s: KeySpace, key: str) -> DataFrame:
    """A scored set, or a plain set whose members score 1."""
    if s.check(key, "zset", "set") == "set":
        return s.elements("set", key).select("member", F.lit(1.0).alias("score"))
    return scored(s, key)


def weighted(rows: DataFrame, weight: float) -> DataFrame:
    x = F.col("score") * weight
    return rows.select("member", F.when(F.isnan(x), 0.0).otherwise(x).alias("score"))


def combine(parts: list[DataFrame], how: str, every: bool) -> DataFrame:
    """Members of all parts (of every part, with ``every``), scores summed, or their least or largest."""
    score = {"SUM": F.sum("score"), "MIN": F.min("score"), "MAX": F.max("score")}[how]
    out = reduce(DataFrame.unionByName, parts).groupBy("member").agg(F.when(F.isnan(score), 0.0).otherwise(score).alias("score"), F.count(F.lit(1)).alias("__in"))
    return (out.where(F.col("__in") == len(parts)) if every else out).select("member", "score")


def subtract(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select("member"), "member", "left_anti"), parts)


def _algebra(op: str, s: KeySpace, args: tuple) -> DataFrame:
    n = integer(args[0]) if args else 0
    if n <= 0:
        raise fail("at least 1 input key is needed")
    keys, rest = [str(k) for k in args[1 : n + 1]], list(args[n + 1 :])
    if len(keys) < n:
        raise fail("syntax error")
    weights, how = [1.0] * n, "SUM"
    while rest:
        o = str(rest.pop(0)).upper()
        if o == "WEIGHTS" and op != "diff" and len(rest) >= n:
            try:
                weights = [number(w) for w in rest[:n]]
            except ValueError as e:
                raise fail("weight value is not a float") from e
            rest = rest[n:]
        elif o == "AGGREGATE" and op != "diff" and rest and str(rest[0]).upper() in ("SUM", "MIN", "MAX"):
            how = str(rest.pop(0)).upper()
        elif o != "WITHSCORES":
            raise fail("syntax error")
    parts = [operand(s, k) for k in keys]
    if op == "diff":
        return subtract(parts)
    return combine([weighted(p, w) for p, w in zip(parts, weights)], how, op == "inter")


def _read(op: str):
    return lambda s, *args: _algebra(op, s, args).orderBy("score", "member")


zunion, zinter, zdiff = _read("union"), _read("inter"), _read("diff")


def _store(op: str):
    def run(s: KeySpace, dst: str, *args: object) -> Written:
        if any(str(a).upper() == "WITHSCORES" for a in args):
            raise fail("syntax error")
        rows = _algebra(op, s, args)
        return Written(s.put("zset", dst, rows, 0), rows.agg(F.count(F.lit(1)).alias("reply")))

    return run


zunionstore, zinterstore, zdiffstore = _store("union"), _store("inter"), _store("diff")


def zintercard(s: KeySpace, *args: object) -> DataFrame:
    keys, most = keys_and_limit(args)
    rows = combine([operand(s, k) for k in keys], "SUM", True)
    return (rows.limit(most) if most else rows).agg(F.count(F.lit(1)).alias("reply"))
