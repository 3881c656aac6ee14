"""Documents without a schema: one VARIANT column, with typed shadow columns for the paths that queries use.

A VARIANT can't be compared, grouped or pruned, so a path that a filter, sort or group needs gets a column of its own;
values of mixed types are ordered and grouped by a key of class rank, number and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import bad
from tessera.functions.values import RANK

DOC = "doc"


def parse(df: DataFrame, text: str, id_path: str | None = "$._id", id_type: str = "bigint") -> DataFrame:
    """``_id`` and ``doc`` of JSON text; text that isn't JSON raises when it is read."""
    v = df.withColumn(DOC, F.parse_json(F.col(text)))
    return v.select(F.try_variant_get(DOC, id_path, id_type).alias("_id"), DOC) if id_path else v


def value(path: str, kind: str) -> Column:
    """A path's value in a type; NULL if it is missing or of another class."""
    return F.try_variant_get(DOC, _json_path(path), kind)


def _json_path(path: str) -> str:
    if not path or any(not p for p in path.split(".")):
        raise bad("FieldPath field names may not be empty strings.", 15998)
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" if not p.isidentifier() else f".{p}" for p in path.split("."))


def shadow(df: DataFrame, **paths: str) -> DataFrame:
    """``df`` with a typed column for each name: ``name="path:type"``. Written out, these prune and push down."""
    columns = {}
    for name, spec in paths.items():
        path, _, kind = spec.rpartition(":")
        columns[name] = value(path, kind)
    return df.withColumns(columns)


def exists(path: str) -> Column:
    """Whether a field is there; null counts."""
    return F.variant_get(DOC, _json_path(path), "variant").isNotNull()


def is_null(path: str) -> Column:
    """Whether a field is there and null."""
    return F.coalesce(F.is_variant_null(F.variant_get(DOC, _json_path(path), "variant")), F.lit(False))


def type_of(path: str) -> Column:
    """The class of a field's value; ``missing`` if it isn't there."""
    v = F.variant_get(DOC, _json_path(path), "variant")
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "missing").when(F.is_variant_null(v), "null").when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(kind == "STRING", "string").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
        .when(kind == "BINARY", "binary").when(kind == "BOOLEAN", "bool").when(kind.rlike("^(TIMESTAMP|DATE)"), "date").otherwise("string")
    )


def total_order(path: str) -> Column:
    """A key that groups and sorts values of any class: rank of the class, number, text. Missing is null, 1 is 1.0,
    NaN is the least number. Integers past 2**53 and objects that differ in the order of their fields compare as equal
    where their doubles or sorted texts do."""
    v = F.variant_get(DOC, _json_path(path), "variant")
    kind = type_of(path)
    rank = F.lit(RANK["null"])
    for name in ("number", "string", "object", "array", "binary", "bool", "date"):
        rank = F.when(kind == name, RANK[name]).otherwise(rank)
    n = F.try_variant_get(DOC, _json_path(path), "double")
    number = F.when(kind == "number", F.when(F.isnan(n), F.lit(float("-inf"))).otherwise(n + 0.0)).when(kind == "bool", F.try_variant_get(DOC, _json_path(path), "boolean").cast("double"))
    text = F.when(kind == "string", F.try_variant_get(DOC, _json_path(path), "string")).when(kind.isin("object", "array", "binary", "date"), F.to_json(v))
    return F.struct(rank.alias("r"), number.alias("n"), text.alias("s"))
