"""What the corpus operators share: words, shared-folder tables, and code shipping."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of 0-9, a-z and non-ASCII characters once A-Z are lower-cased; every other byte separates.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

T = TypeVar("T")

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[object, str]] = []


def words_of(raw: bytes | None) -> list[bytes]:
    """The lower-cased words of UTF-8 text, as bytes. Null has none."""
    return raw.translate(WORD_BYTES).split() if raw else []


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by its own path: by that path where all workers
    are on this machine, else by a zip of the package that Spark hands to every executor."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if sc.master.startswith("local"):
        env = sc.environment
        if str(root) not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (str(root), env.get("PYTHONPATH")) if x)
    elif sc.applicationId not in _shipped:
        sc.addPyFile(zipped(root))
        _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def zipped(root: Path) -> str:
    """A zip of the package's modules, on the driver only."""
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera-modules.zip"
    with zipfile.ZipFile(path, "w") as z:
        for module in sorted(root.glob("tessera/**/*.py")):
            z.write(module, module.relative_to(root))
    return str(path)


_remembered: dict[str, object] = {}


def remembered(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one thing, the last asked for, so that operators that follow one
    another in a worker don't add up their memories."""
    if name not in _remembered:
        _remembered.clear()
        _remembered[name] = make()
    return _remembered[name]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and
    all executors are threads of this process. Elsewhere an unset folder is an error: rows would be missed."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation before this
    point. The write's shuffle files, which nothing reads again, are freed at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._settled = path
    return back


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled inside are removed at the end, but for those passed to the function given."""
    before, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._settled)
        return df

    yield keep
    for spark, path in [w for w in _written[before:] if w[1] not in kept]:
        _remove(spark, path)
        _written.remove((spark, path))


#: Rows that one task takes where rows are small.
TASK_ROWS = 50_000


def tasks_for(rows: int) -> int:
    """Tasks for so many small rows. Few rows need one task, which then groups and joins them without a shuffle; in
    hundreds of tasks they would only make hundreds of empty files."""
    return rows // TASK_ROWS + 1


def packed(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` settled, in as many partitions as its rows call for, and their number."""
    df = settle(df, name)
    n = df.count()
    return df.coalesce(tasks_for(n)), n


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _forget() -> None:
    """Remove this session's settled tables, if the session still lives."""
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: its shared folder is the cluster's to clean
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
