"""Queries over the test tables, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.catalogue import documents, keyspace
from tessera.operators.find import aggregate
from tessera.sample import table

FLAGSHIP = """[
 {"$match": {"l_shipdate": {"$lte": {"$date": "1998-09-02T00:00:00Z"}}}},
 {"$group": {"_id": {"f": "$l_returnflag", "s": "$l_linestatus"},
             "qty": {"$sum": "$l_quantity"}, "avg": {"$avg": "$l_discount"}, "n": {"$count": {}}}},
 {"$sort": {"_id": 1}}]"""


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by flag and status."""
    return aggregate(table(spark, sf_dir, "lineitem"), FLAGSHIP)


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return documents.QUERIES | keyspace.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
