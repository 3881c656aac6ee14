"""Pipelines over event streams, an extension: windows with late data, and the engine's filters before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import ejson
from tessera.functions.filters import where_filter
from tessera.functions.values import Root


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of files as they arrive, ``ts`` as an instant."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def where(stream: DataFrame, filter: object) -> DataFrame:
    """The events that meet a filter document."""
    return stream.where(where_filter(ejson.parse(filter), Root(stream.schema)))


def windowed(stream: DataFrame, every: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by window and keys; events later than ``late`` are dropped, which bounds the state."""
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    return stream.withWatermark("ts", late).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sessions(stream: DataFrame, gap: str, late: str, by: list[str]) -> DataFrame:
    """Sessions: runs of a key's events with no pause of ``gap`` between them."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by).agg(F.count(F.lit(1)).alias("n"))
