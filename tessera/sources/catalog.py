"""Named collections in immutable versions, leases on versions, and cursors.

A collection is a folder; each write adds a version folder and moves a pointer. A lease names a version for a while;
reads under it see that version whatever is written meanwhile.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.errors import QueryError, bad
from tessera.operators import find as finds
from tessera.operators import updates

# Defaults of leases and pages.
MOST_LEASES, LEASE_S, LONGEST_LEASE_S, PAGE_ROWS = 32, 60, 600, 101


@dataclass
class Index:
    """A hint for the layout of files: the columns that they are sorted by."""

    name: str
    keys: list[tuple[str, int]]
    unique: bool = False
    sparse: bool = False


@dataclass
class Collection:
    name: str
    version: int = 0
    indexes: list[Index] = field(default_factory=list)


@dataclass
class Lease:
    id: int
    versions: dict[str, int]
    expires: float


class Catalog:
    """Collections under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.collections: dict[str, Collection] = {}
        self.leases: dict[int, Lease] = {}
        self._next = 1

    # ---- collections

    def create(self, name: str, rows: DataFrame | None = None) -> Collection:
        if name in self.collections:
            raise QueryError(48, f"Collection {name} already exists.")
        self.collections[name] = Collection(name)
        if rows is not None:
            self._write(name, rows)
        return self.collections[name]

    def drop(self, name: str) -> bool:
        return self.collections.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.collections)

    def stats(self, name: str) -> dict[str, object]:
        c = self._get(name)
        return {"ns": name, "version": c.version, "count": self.read(name).count() if c.version else 0, "indexes": [i.name for i in c.indexes]}

    def _get(self, name: str) -> Collection:
        if name not in self.collections:
            raise QueryError(26, f"ns not found: {name}")
        return self.collections[name]

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version}"

    def _write(self, name: str, rows: DataFrame) -> None:
        """A new version, if it keeps the unique indexes; rows without any of a sparse index's keys don't count for it."""
        c = self._get(name)
        for i in c.indexes:
            if i.unique and not self._twice(rows, i).isEmpty():
                raise QueryError(11000, f"E11000 duplicate key error collection: {name} index: {i.name}")
        keys = [k for k, _ in c.indexes[0].keys if "." not in k] if c.indexes else []
        out = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys and all(k in rows.columns for k in keys) else rows
        out.write.mode("errorifexists").parquet(self._path(name, c.version + 1))
        c.version += 1

    def read(self, name: str, lease: int | None = None) -> DataFrame:
        """The newest version, or the one that a lease holds; no rows of a collection that isn't there or was never written."""
        known = self.collections.get(name)
        version = self._lease(lease).versions.get(name, 0) if lease is not None else known.version if known else 0
        if not version:
            return self.spark.createDataFrame([], "_id bigint")
        return self.spark.read.parquet(self._path(name, version))

    # ---- indexes, as layouts

    def create_index(self, name: str, keys: dict[str, int], unique: bool = False, sparse: bool = False, label: str | None = None) -> str:
        if not keys or len(keys) > 32:
            raise bad("index keys cannot be empty" if not keys else "too many index keys")
        if any(v not in (1, -1, "2dsphere") for v in keys.values()):
            raise bad("Values in v:2 index key pattern must be 1, -1 or '2dsphere'")
        c = self._get(name)
        label = label or "_".join(f"{k}_{v}" for k, v in keys.items())
        if any(i.name == label for i in c.indexes):
            return label
        if len(c.indexes) >= 64:
            raise bad("too many indexes")
        index = Index(label, list(keys.items()), unique, sparse)
        if unique and c.version and not self._twice(self.read(name), index).isEmpty():
            raise QueryError(11000, f"E11000 duplicate key error collection: {name} index: {label}")
        c.indexes.append(index)
        if c.version and len(c.indexes) == 1:
            self._write(name, self.read(name))
        return label

    def drop_index(self, name: str, label: str) -> bool:
        c = self._get(name)
        left = [i for i in c.indexes if i.name != label]
        found = len(left) < len(c.indexes)
        c.indexes = left
        return found

    def indexes(self, name: str) -> list[Index]:
        return list(self._get(name).indexes)

    @staticmethod
    def _twice(rows: DataFrame, index: Index) -> DataFrame:
        """Keys of a unique index that several rows hold; a column that the rows lack is null in all."""
        cols = [F.col(k) if k.split(".")[0] in rows.columns else F.lit(None).cast("string") for k, _ in index.keys]
        held = rows.where(F.coalesce(*[c.cast("string") for c in cols]).isNotNull()) if index.sparse else rows
        return held.select(*[c.alias(f"k{i}") for i, c in enumerate(cols)]).groupBy(*[f"k{i}" for i in range(len(cols))]).count().where("count > 1")

    def duplicates(self, name: str, keys: list[str]) -> DataFrame:
        """Key values that several rows hold."""
        return self.read(name).groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    # ---- writes: each makes a version

    def insert(self, name: str, rows: DataFrame) -> None:
        c = self._get(name)
        self._write(name, updates.insert(self.read(name), rows) if c.version else rows)

    def update(self, name: str, filter: object, spec: object, **more: object) -> None:
        self._write(name, updates.update(self.read(name), filter, spec, **more))

    def delete(self, name: str, filter: object, multi: bool = True) -> None:
        self._write(name, updates.delete(self.read(name), filter, multi))

    # ---- reads

    def find(self, name: str, *args: object, lease: int | None = None, **more: object) -> DataFrame:
        return finds.find(self.read(name, lease), *args, **more)

    def get(self, name: str, id: object, lease: int | None = None) -> DataFrame:
        return finds.find(self.read(name, lease), {"_id": id})

    def aggregate(self, name: str, pipeline: object, lease: int | None = None, wide: bool = False) -> DataFrame:
        return finds.aggregate(self.read(name, lease), pipeline, wide)

    def count(self, name: str, filter: object = None, lease: int | None = None) -> DataFrame:
        return finds.count(self.read(name, lease), filter)

    def distinct(self, name: str, path: str, filter: object = None, lease: int | None = None) -> DataFrame:
        return finds.distinct(self.read(name, lease), path, filter)

    # ---- leases

    def snapshot(self, seconds: float = LEASE_S) -> int:
        """A lease on every collection's present version."""
        self._reap()
        if len(self.leases) >= MOST_LEASES:
            raise bad(f"too many snapshots: the limit is {MOST_LEASES}")
        if not 0 < seconds <= LONGEST_LEASE_S:
            raise bad(f"a lease lasts at most {LONGEST_LEASE_S} seconds")
        lease = Lease(self._next, {n: c.version for n, c in self.collections.items()}, self.clock() + seconds)
        self.leases[lease.id], self._next = lease, self._next + 1
        return lease.id

    def release(self, lease: int) -> bool:
        self._reap()
        return self.leases.pop(lease, None) is not None

    def snapshots(self) -> list[Lease]:
        self._reap()
        return [self.leases[i] for i in sorted(self.leases)]

    def _lease(self, lease: int) -> Lease:
        self._reap()
        if lease not in self.leases:
            raise bad(f"no such snapshot: {lease}")
        return self.leases[lease]

    def _reap(self) -> None:
        now = self.clock()
        self.leases = {i: x for i, x in self.leases.items() if x.expires > now}


class Cursor:
    """Pages of a result in order of a key, nulls first: each page is a query for the rows from the last key on, so a
    cursor holds nothing open and goes on after any failure. Rows of one key come in the order of their hashes, and
    those already given are skipped."""

    def __init__(self, df: DataFrame, key: str = "_id", rows: int = PAGE_ROWS):
        self.df, self.key, self.rows = df, key, rows
        self.last: object = None
        self.given = 0  # rows of the last key
        self.done = False

    def next(self, rows: int | None = None) -> list[Row]:
        if self.done:
            return []
        left = self.df if self.last is None else self.df.where(F.col(self.key) >= F.lit(self.last))
        page = left.orderBy(F.col(self.key).asc_nulls_first(), F.xxhash64(*self.df.columns)).offset(self.given).limit(rows or self.rows).collect()
        self.done = len(page) < (rows or self.rows)
        if page:
            again, last = page[-1][self.key] == self.last, page[-1][self.key]
            same = sum(r[self.key] == last for r in page)
            self.last, self.given = last, self.given + same if again else same
        return page

    def __iter__(self) -> Iterator[Row]:
        while page := self.next():
            yield from page
