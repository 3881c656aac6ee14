"""The key space: five tables, and what every command does with them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import QueryError

# The tables' columns, the types of keys, and two errors that clients know.
SCHEMAS = {
    "meta": "db int, key string, type string, expire_ms bigint, payload string",
    "hash": "db int, key string, field string, value string",
    "set": "db int, key string, member string",
    "list": "db int, key string, idx bigint, value string",
    "zset": "db int, key string, member string, score double",
}
ELEMENTS = ("hash", "set", "list", "zset")
WRONG_TYPE = "WRONGTYPE Operation against a key holding the wrong kind of value"
NO_KEY = "ERR no such key"


def fail(msg: str) -> QueryError:
    return QueryError(0, msg if msg.split(" ")[0].isupper() else f"ERR {msg}")


@dataclass(frozen=True)
class KeySpace:
    """Tables of all databases, the database that commands act on, and the time that they take for now."""

    meta: DataFrame
    hash: DataFrame
    set: DataFrame
    list: DataFrame
    zset: DataFrame
    db: int = 0
    now_ms: int = 0
    #: Types of keys looked up so far, None for those that aren't there. Each space has its own.
    known: dict = field(default_factory=dict, init=False, compare=False, repr=False)

    @staticmethod
    def empty(spark: SparkSession, now_ms: int = 0) -> "KeySpace":
        return KeySpace(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}, now_ms=now_ms)

    @staticmethod
    def of(spark: SparkSession, now_ms: int = 0, **elements: DataFrame) -> "KeySpace":
        """A space of element tables, whose keys are made of them; ``meta`` rows may be given for strings and expiry."""
        base = KeySpace.empty(spark, now_ms)
        tables = {n: d.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in SCHEMAS[n].split(", ")]) for n, d in elements.items()}
        meta = tables.pop("meta", base.meta)
        for n, d in tables.items():
            made = d.select("db", "key").distinct().select("db", "key", F.lit(n).alias("type"), F.lit(0).cast("bigint").alias("expire_ms"), F.lit(None).cast("string").alias("payload"))
            meta = meta.unionByName(made.join(meta.select("db", "key"), ["db", "key"], "left_anti"))
        return replace(base, meta=meta, **tables)

    @property
    def spark(self) -> SparkSession:
        return self.meta.sparkSession

    # ---- reading

    def live(self) -> DataFrame:
        """Keys of this database that haven't expired."""
        return self.meta.where((F.col("db") == self.db) & self.alive())

    def alive(self) -> Column:
        return (F.col("expire_ms") == 0) | (F.col("expire_ms") > self.now_ms)

    def type_of(self, key: str) -> str | None:
        """A live key's type; None if there is none."""
        if key not in self.known:
            self.learn([key])
        return self.known[key]

    def learn(self, keys: list[str]) -> None:
        """Look up the types of the keys that a command names, in one job."""
        left = list(dict.fromkeys(k for k in keys if k not in self.known))
        if left:
            found = {r[0]: r[1] for r in self.live().where(F.col("key").isin(left)).select("key", "type").collect()}
            self.known.update({k: found.get(k) for k in left})

    def check(self, key: str, kind: str, *more: str) -> str | None:
        found = self.type_of(key)
        if found is not None and found != kind and found not in more:
            raise QueryError(0, WRONG_TYPE)
        return found

    def elements(self, kind: str, key: str) -> DataFrame:
        """The elements of one key; none if the key is missing or has expired. Another type raises."""
        there = self.check(key, kind) is not None
        t = getattr(self, kind).where((F.col("db") == self.db) & (F.col("key") == key))
        return (t if there else t.limit(0)).drop("db", "key")

    def all_elements(self, kind: str) -> DataFrame:
        """``key`` and elements of every live key of a type: one plan for all keys."""
        keys = self.live().where(F.col("type") == kind).select("key")
        return getattr(self, kind).where(F.col("db") == self.db).drop("db").join(keys, "key", "left_semi")

    def ordered(self, values: list[object], column: str) -> DataFrame:
        """``at`` and a column of the values, in order, repetitions kept."""
        return self.spark.createDataFrame(list(enumerate(values)), f"at int, {column} string")

    def value(self, value: object, kind: str = "bigint") -> DataFrame:
        return self.spark.range(1).select(F.lit(value).cast(kind).alias("reply"))

    # ---- writing

    def here(self, key: str) -> Column:
        return (F.col("db") == self.db) & (F.col("key") == key)

    def without(self, *keys: str) -> "KeySpace":
        """The space without these keys, whatever their types."""
        gone = (F.col("db") == self.db) & F.col("key").isin(*keys)
        return replace(self, **{n: getattr(self, n).where(~gone) for n in SCHEMAS})

    def put(self, kind: str, key: str, rows: DataFrame | None, expire_ms: int | None = None, payload: Column | str | None = None) -> "KeySpace":
        """The space with one key's content replaced. ``rows``: its elements; a collection without any vanishes.
        ``expire_ms`` None keeps the key's expiry."""
        keep = self.live().where(F.col("key") == key).select("expire_ms").first() if expire_ms is None else None
        expires = expire_ms if expire_ms is not None else keep[0] if keep else 0
        base = self.without(key)
        head = lambda src: src.select(F.lit(self.db).alias("db"), F.lit(key).alias("key"), F.lit(kind).alias("type"), F.lit(expires).cast("bigint").alias("expire_ms"), (payload if isinstance(payload, Column) else F.lit(payload).cast("string")).alias("payload"))
        if kind == "string":
            return replace(base, meta=base.meta.unionByName(head(self.spark.range(1))))
        columns = [c.split(" ")[0] for c in SCHEMAS[kind].split(", ")]
        full = rows.select(F.lit(self.db).alias("db"), F.lit(key).alias("key"), *columns[2:])
        return replace(base, meta=base.meta.unionByName(head(rows.limit(1))), **{kind: getattr(base, kind).unionByName(full)})

    def expiring(self, key: str, expire_ms: int) -> "KeySpace":
        return replace(self, meta=self.meta.withColumn("expire_ms", F.when(self.here(key), F.lit(expire_ms).cast("bigint")).otherwise(F.col("expire_ms"))))


@dataclass(frozen=True)
class Written:
    """A write's outcome: the space after it, and its reply."""

    space: KeySpace
    reply: DataFrame


Command = Callable[..., DataFrame | Written]


def integer(text: object) -> int:
    try:
        n = int(str(text))
    except ValueError as e:
        raise fail("value is not an integer or out of range") from e
    if not -(1 << 63) <= n < 1 << 63:
        raise fail("value is not an integer or out of range")
    return n


def number(text: object) -> float:
    t = str(text).lower()
    try:
        x = float("inf") if t in ("inf", "+inf") else float("-inf") if t == "-inf" else float(t)
    except ValueError as e:
        raise fail("value is not a valid float") from e
    if x != x:
        raise fail("value is not a valid float")
    return x


def span(start: int, stop: int, n: Column) -> tuple[Column, Column]:
    """First and last position of a range over ``n`` elements; negative positions count from the end."""
    lo = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    hi = F.lit(stop) if stop >= 0 else n + stop
    return lo, F.least(hi, n - 1)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for ``*``, ``?``, classes and escapes."""
    out, i = [], 0
    quote = lambda c: "\\" + c if not (c.isalnum() or c == "_") and ord(c) < 128 else c
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(quote(pattern[i]))
        elif c == "[":
            i += 1
            negated = pattern[i : i + 1] == "^"
            i += negated
            parts: list[str] = []
            while i < len(pattern) and pattern[i] != "]":
                if pattern[i] == "\\" and i + 1 < len(pattern):
                    i += 1
                    parts.append(quote(pattern[i]))
                elif pattern[i + 1 : i + 2] == "-" and i + 2 < len(pattern):
                    lo, hi = sorted((pattern[i], pattern[i + 2]))
                    parts.append(f"{quote(lo)}-{quote(hi)}")
                    i += 2
                else:
                    parts.append(quote(pattern[i]))
                i += 1
            out.append(f"[{'^' if negated else ''}{''.join(parts)}]" if parts else ("." if negated else "[^\\s\\S]"))
        else:
            out.append(quote(c))
        i += 1
    return f"(?s)^{''.join(out)}(?!.)"


def matches(column: Column, pattern: str | None) -> Column:
    """A glob's test; a literal beginning is tested apart, for the scan to prune by."""
    if pattern is None or pattern == "*":
        return F.lit(True)
    prefix = ""
    for c in pattern:
        if c in "*?[\\":
            break
        prefix += c
    test = column.rlike(glob_regex(pattern))
    return column.startswith(prefix) & test if prefix else test
