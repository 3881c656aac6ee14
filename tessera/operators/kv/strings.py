"""String commands. Lengths and positions are of UTF-8 bytes."""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.kv.base import KeySpace, Written, fail, integer, span
from tessera.operators.kv.keys import options_of


def _row(s: KeySpace, key: str) -> tuple[str | None, int]:
    """A live string's text and expiry, None if there is none."""
    s.check(key, "string")
    row = s.live().where(F.col("key") == key).select("payload", "expire_ms").first()
    return (row[0], row[1]) if row else (None, 0)


def get(s: KeySpace, key: str) -> DataFrame:
    s.check(key, "string")
    return s.ordered([key], "key").join(s.live().select("key", "payload"), "key", "left").select(F.col("payload").alias("reply"))


def _expiry(s: KeySpace, o: dict) -> int | None:
    """The moment that EX, PX, EXAT or PXAT name; None without one."""
    given = [n for n in ("EX", "PX", "EXAT", "PXAT") if n in o]
    if len(given) > 1:
        raise fail("syntax error")
    if not given:
        return None
    n = integer(o[given[0]][0])
    if n <= 0:
        raise fail("invalid expire time in 'set' command")
    return n * (1000 if given[0].startswith("EX") else 1) + (0 if given[0].endswith("AT") else s.now_ms)


def set_(s: KeySpace, key: str, value: str, *args: object) -> Written:
    o = options_of(args, {"NX": 0, "XX": 0, "GET": 0, "KEEPTTL": 0, "EX": 1, "PX": 1, "EXAT": 1, "PXAT": 1})
    if "NX" in o and "XX" in o or "KEEPTTL" in o and any(n in o for n in ("EX", "PX", "EXAT", "PXAT")):
        raise fail("syntax error")
    at = _expiry(s, o)
    old, before = _row(s, key) if "GET" in o else (None, 0)
    there = s.type_of(key) is not None
    done = not ("NX" in o and there or "XX" in o and not there)
    space = s
    if done:
        keep = s.live().where(F.col("key") == key).select("expire_ms").first() if "KEEPTTL" in o else None
        space = s.put("string", key, None, at if at is not None else keep[0] if keep else 0, value)
        if at is not None and at <= s.now_ms:
            space = s.without(key)
    return Written(space, s.value(old if "GET" in o else "OK" if done else None, "string"))


def setnx(s: KeySpace, key: str, value: str) -> Written:
    there = s.type_of(key) is not None
    return Written(s if there else s.put("string", key, None, 0, value), s.value(int(not there)))


def setex(s: KeySpace, key: str, seconds: object, value: str) -> Written:
    return set_(s, key, value, "EX", seconds)


def psetex(s: KeySpace, key: str, ms: object, value: str) -> Written:
    return set_(s, key, value, "PX", ms)


def getset(s: KeySpace, key: str, value: str) -> Written:
    return set_(s, key, value, "GET")


def getdel(s: KeySpace, key: str) -> Written:
    old, _ = _row(s, key)
    return Written(s.without(key), s.value(old, "string"))


def getex(s: KeySpace, key: str, *args: object) -> Written:
    o = options_of(args, {"PERSIST": 0, "EX": 1, "PX": 1, "EXAT": 1, "PXAT": 1})
    old, _ = _row(s, key)
    at = _expiry(s, o)
    space = s
    if old is not None and ("PERSIST" in o or at is not None):
        space = s.expiring(key, 0 if at is None else at) if at is None or at > s.now_ms else s.without(key)
    return Written(space, s.value(old, "string"))


def mget(s: KeySpace, *keys: str) -> DataFrame:
    """A row for each key given, in order; null for missing keys and other types."""
    texts = s.live().where(F.col("type") == "string").select("key", "payload")
    return s.ordered(list(keys), "key").join(texts, "key", "left").orderBy("at").select("at", "key", F.col("payload").alias("value"))


def _pairs(args: tuple, command: str) -> dict[str, str]:
    if not args or len(args) % 2:
        raise fail(f"wrong number of arguments for '{command}' command")
    return dict(zip(args[::2], args[1::2]))


def mset(s: KeySpace, *args: str) -> Written:
    space = s
    for k, v in _pairs(args, "mset").items():
        space = space.put("string", k, None, 0, v)
    return Written(space, s.value("OK", "string"))


def msetnx(s: KeySpace, *args: str) -> Written:
    pairs = _pairs(args, "msetnx")
    if not s.live().where(F.col("key").isin(*pairs)).isEmpty():
        return Written(s, s.value(0))
    return Written(mset(s, *args).space, s.value(1))


def incrby(s: KeySpace, key: str, n: object) -> Written:
    old, _ = _row(s, key)
    new = integer(old or "0") + integer(n)
    if not -(1 << 63) <= new < 1 << 63:
        raise fail("increment or decrement would overflow")
    return Written(s.put("string", key, None, None, str(new)), s.value(new))


def incr(s: KeySpace, key: str) -> Written:
    return incrby(s, key, 1)


def decr(s: KeySpace, key: str) -> Written:
    return incrby(s, key, -1)


def decrby(s: KeySpace, key: str, n: object) -> Written:
    return incrby(s, key, -integer(n))


def plain_decimal(x: Decimal) -> str:
    """At most 17 places, without trailing zeros or an exponent."""
    text = format(round(x, 17), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def added(old: str | None, by: object) -> str:
    with localcontext() as c:
        c.prec = 60
        try:
            a, b = Decimal(old or "0"), Decimal(str(by))
        except ArithmeticError as e:
            raise fail("value is not a valid float") from e
        if not (a.is_finite() and b.is_finite()):
            raise fail("increment would produce NaN or Infinity")
        out = plain_decimal(a + b)
        return "0" if out == "-0" else out


def incrbyfloat(s: KeySpace, key: str, by: object) -> Written:
    old, _ = _row(s, key)
    new = added(old, by)
    return Written(s.put("string", key, None, None, new), s.value(new, "string"))


def append(s: KeySpace, key: str, text: str) -> Written:
    old, _ = _row(s, key)
    new = (old or "") + text
    return Written(s.put("string", key, None, None, new), s.value(len(new.encode())))


def strlen(s: KeySpace, key: str) -> DataFrame:
    return get(s, key).select(F.coalesce(F.octet_length("reply"), F.lit(0)).cast("bigint").alias("reply"))


def byte_range(text: Column, start: int, stop: int) -> Column:
    """Bytes ``start`` to ``stop``, both counted, negative ones from the end; a character that is cut is replaced."""
    n = F.octet_length(text)
    lo, hi = span(start, stop, n)
    return F.when((hi < lo) | (n == 0), F.lit("")).otherwise(F.decode(F.substring(text.cast("binary"), (lo + 1).cast("int"), (hi - lo + 1).cast("int")), "UTF-8"))


def getrange(s: KeySpace, key: str, start: object, stop: object) -> DataFrame:
    return get(s, key).select(byte_range(F.coalesce("reply", F.lit("")), integer(start), integer(stop)).alias("reply"))


def setrange(s: KeySpace, key: str, offset: object, text: str) -> Written:
    at = integer(offset)
    if at < 0:
        raise fail("offset is out of range")
    old, _ = _row(s, key)
    raw, new = (old or "").encode(), text.encode()
    if not new:
        return Written(s, s.value(len(raw)))
    out = raw.ljust(at, b"\0")[:at] + new + raw[at + len(new) :]
    return Written(s.put("string", key, None, None, out.decode("utf-8", "replace")), s.value(len(out)))


def lengths(s: KeySpace) -> DataFrame:
    """``key``, ``length`` of every live string, in one plan."""
    return s.live().where(F.col("type") == "string").select("key", F.octet_length("payload").cast("bigint").alias("length"))


