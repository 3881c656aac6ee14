"""Readers and writers of collections. Columns and filters that a query doesn't need never leave the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import bad

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, **options: object) -> DataFrame:
    """A collection from files. JSON and CSV need a schema: guessing one reads all the data twice."""
    if format not in FORMATS:
        raise bad(f"unknown file format: {format}")
    if format in ("json", "csv") and schema is None:
        raise bad(f"{format} files need a schema")
    r = spark.read.options(**options)
    return (r.schema(schema) if schema is not None else r).format(format).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", sorted_by: list[str] | None = None, partitions: int | None = None, **options: object) -> None:
    """Files of a collection. ``sorted_by`` lays rows out in ranges of these columns, so that the files' least and
    largest values let scans skip what a range or point condition excludes: what an index is here."""
    if format not in FORMATS:
        raise bad(f"unknown file format: {format}")
    if sorted_by:
        df = df.repartitionByRange(*([partitions] if partitions else []), *sorted_by).sortWithinPartitions(*sorted_by)
    df.write.mode("errorifexists").format(format).options(**options).save(path)


def extended_json(df: DataFrame) -> DataFrame:
    """``doc``: each row as relaxed JSON text, dates as ISO text."""
    return df.select(F.to_json(F.struct("*"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}).alias("doc"))


def typed_json(lines: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """Documents of JSON text in a column, as typed rows; text that doesn't parse gives a row of NULLs."""
    return lines.select(F.from_json(column, schema).alias("d")).select("d.*")
