"""Typed columns: classes and order of values, literals, and the two ways to walk a path.

A column's NULL stands for a missing field; an explicit null can't be told apart from it in typed frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import bad
from tessera.functions.ejson import Long, ObjectId, Regex, Special, type_name

# The order of the classes of values.
RANK = {"minKey": 10, "undefined": 15, "null": 20, "number": 30, "string": 60, "object": 70, "array": 80, "binary": 90, "objectId": 100, "bool": 110, "date": 120, "regex": 140, "maxKey": 240}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass
class Value:
    """A column and its type; ``type`` None is a field that the schema doesn't have, ``literal`` a constant's value."""

    col: Column
    type: T.DataType | None
    literal: object = None
    constant: bool = False

    @property
    def missing(self) -> bool:
        return self.type is None



def missing() -> Value:
    return Value(F.lit(None), None)


def class_of(kind: T.DataType | None) -> str:
    """The class of a type's values."""
    if kind is None or isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, DATES):
        return "date"
    if isinstance(kind, T.StructType):
        return "object"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.BinaryType):
        return "binary"
    raise bad(f"values of type {kind.simpleString()} can't be queried")


def type_text(kind: T.DataType | None) -> str:
    """The name that error texts give a type."""
    if kind is None:
        return "missing"
    c = class_of(kind)
    if c == "number":
        return "long" if isinstance(kind, T.LongType) else "int" if isinstance(kind, INTEGERS) else "decimal" if isinstance(kind, T.DecimalType) else "double"
    return {"binary": "binData"}.get(c, c)


def is_float(kind: T.DataType | None) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def literal(v: object) -> Value:
    """A constant."""
    make = lambda col, kind: Value(col, kind, v, True)
    if v is None:
        return make(F.lit(None), T.NullType())
    if isinstance(v, bool):
        return make(F.lit(v), T.BooleanType())
    if isinstance(v, int):
        wide = isinstance(v, Long) or not -(1 << 31) <= v < 1 << 31
        return make(F.lit(int(v)).cast("bigint" if wide else "int"), T.LongType() if wide else T.IntegerType())
    if isinstance(v, float):
        return make(F.lit(v), T.DoubleType())
    if isinstance(v, Decimal):
        raise bad("Decimal128 is not supported here")
    if isinstance(v, str):
        return make(F.lit(v), T.StringType())
    if isinstance(v, datetime):
        return make(F.lit(v.astimezone(timezone.utc).replace(tzinfo=None)), T.TimestampNTZType())
    if isinstance(v, ObjectId):
        return make(F.lit(v.hex), T.StringType())
    if isinstance(v, (list, tuple)):
        parts = [literal(x) for x in v]
        inner = widest([p.type for p in parts]) or T.StringType()
        return make(F.array(*[p.col.cast(inner) for p in parts]) if parts else F.array().cast(T.ArrayType(inner)), T.ArrayType(inner))
    if isinstance(v, dict):
        parts = {k: literal(x) for k, x in v.items()}
        return make(F.struct(*[p.col.alias(k) for k, p in parts.items()]), T.StructType([T.StructField(k, p.type) for k, p in parts.items()]))
    if isinstance(v, (Regex, Special)):
        return Value(F.lit(None), T.NullType(), v, True)
    raise bad(f"a {type_name(v)} can't be a constant here")


def widest(kinds: list[T.DataType | None]) -> T.DataType | None:
    """A type that holds all; None if there is none."""
    real = [k for k in kinds if k is not None and not isinstance(k, T.NullType)]
    if not real:
        return None
    if all(k == real[0] for k in real):
        return real[0]
    classes = {class_of(k) for k in real}
    if classes == {"number"}:
        return T.LongType() if all(isinstance(k, INTEGERS) for k in real) else T.DoubleType()
    if classes == {"date"}:
        return T.TimestampNTZType()
    raise bad(f"a column can't hold both {' and '.join(sorted(type_text(k) for k in real))}")


def comparable(a: Value, b: Value) -> tuple[Column, Column]:
    """Both columns in one type of their class."""
    if class_of(a.type) == "number" and a.type != b.type and (isinstance(a.type, T.DecimalType) or isinstance(b.type, T.DecimalType)):
        return a.col.cast("decimal(38,18)"), b.col.cast("decimal(38,18)")
    if class_of(a.type) == "date" and a.type != b.type:
        return a.col.cast("timestamp_ntz"), b.col.cast("timestamp_ntz")
    return a.col, b.col


def below(a: Value, b: Value, equal: bool = False) -> Column:
    """a < b (or a <= b) for values of one class that aren't null; NaN is below all numbers and equal to itself."""
    x, y = comparable(a, b)
    plain = x <= y if equal else x < y
    if not (is_float(a.type) or is_float(b.type)):
        return plain
    nan = lambda v, c: F.isnan(c) if is_float(v.type) else F.lit(False)
    return F.when(nan(a, x), F.lit(True) if equal else ~nan(b, y)).when(nan(b, y), F.lit(False)).otherwise(plain)


# ---- paths


def parts_of(path: str) -> list[str]:
    parts = path.split(".")
    if "" in parts:
        raise bad("FieldPath field names may not be empty strings.", 15998)
    return parts


def child(v: Value, name: str) -> Value:
    """A struct's field; missing if it has none."""
    if isinstance(v.type, T.StructType) and name in v.type.fieldNames():
        return Value(v.col[name] if not isinstance(v, Root) else v.field(name), v.type[name].dataType)
    return missing()


class Root(Value):
    """A row: its columns are its fields."""

    def __init__(self, schema: T.StructType, prefix: str = ""):
        shown = T.StructType([f for f in schema.fields if not f.name.startswith("__")])
        super().__init__(None, shown)
        self.prefix = prefix

    def field(self, name: str) -> Column:
        return F.col(self.prefix + "`" + name.replace("`", "``") + "`")

    def whole(self) -> Column:
        return F.struct(*[self.field(n).alias(n) for n in self.type.fieldNames()])


def plain_path(v: Value, parts: list[str]) -> Value:
    """Walk through documents only."""
    for p in parts:
        v = child(v, p)
    return v


def aggregation_path(v: Value, parts: list[str]) -> Value:
    """Walk as expressions do: a path into an array maps over its documents; numbers are names."""
    for i, p in enumerate(parts):
        if isinstance(v.type, T.ArrayType):
            rest = parts[i:]
            inner = v.type.elementType
            probe = aggregation_path(Value(F.lit(None), inner), rest)
            if probe.missing:
                return Value(F.when(v.col.isNotNull(), F.expr("array()").cast("array<string>")), T.ArrayType(T.StringType()))
            out = F.transform(v.col, lambda x: aggregation_path(Value(x, inner), rest).col)
            return Value(F.filter(out, lambda x: x.isNotNull()), T.ArrayType(probe.type))
        v = child(v, p)
    return v


def any_match(v: Value, parts: list[str], test: Callable[[Value], Column]) -> Column:
    """Walk as filters do: through arrays at every level, a number also being a position. ``test`` judges each end."""
    if not parts:
        return test(v)
    if isinstance(v.type, T.ArrayType):
        inner = v.type.elementType
        found: Column | None = None
        if isinstance(inner, (T.StructType, T.ArrayType)):
            found = F.coalesce(F.exists(v.col, lambda x: any_match(Value(x, inner), parts, test)), F.lit(False))
        if parts[0].isdigit():
            at = any_match(Value(F.get(v.col, F.lit(int(parts[0]))), inner), parts[1:], test)
            at = at & (F.size(v.col) > int(parts[0]))
            found = at if found is None else found | at
        elif found is None:
            return test(missing())
        return F.when(v.col.isNull(), test(missing())).otherwise(found)
    return any_match(child(v, parts[0]), parts[1:], test)
