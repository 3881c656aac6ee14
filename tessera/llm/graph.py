"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, tasks_for


def _stars(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step over undirected links (a > b once each). Large: larger neighbours join the least neighbour;
    small: smaller ones and the node itself do."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return new.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(tasks).distinct().coalesce(tasks)


def _is_stars(links: DataFrame) -> bool:
    """Whether every node is either a centre or has one link to one."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (its least node) for every node of a link between two different nodes.

    Null ends and self-links are no links; direction and repetition don't matter; no links, no rows. Links are
    never collected to the driver; each round is settled in the shared folder. As few as one task takes go to one task.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    now = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    now, n = packed(now, "links")
    while n and not _is_stars(now):
        tasks = tasks_for(2 * n)
        now, n = packed(_stars(_stars(now, True, tasks), False, tasks), "links")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
