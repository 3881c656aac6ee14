"""Aggregation expressions, compiled to columns with their types.

Missing fields are NULL. Integers are computed as bigint; with ``wide``, sums, differences and products of integers
are doubles wherever bigint can't hold them, and so doubles in every row, as a column has one type.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import QueryError, bad
from tessera.functions.ejson import type_name
from tessera.functions.values import INTEGERS, RANK, Root, Value, aggregation_path, below, class_of, is_float, literal, missing, parts_of, type_text, widest

# Operators and the numbers of arguments that they take (None: any).
ARITY: dict[str, int | None] = {
    "$add": None, "$subtract": 2, "$multiply": None, "$divide": 2, "$mod": 2,
    "$eq": 2, "$ne": 2, "$gt": 2, "$gte": 2, "$lt": 2, "$lte": 2,
    "$and": None, "$or": None, "$not": 1, "$ifNull": None, "$concat": None, "$toLower": 1, "$toUpper": 1, "$size": 1,
}
DATE_PARTS = {"$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth}
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OFFSET = re.compile(r"[+-]\d{2}(:?\d{2})?$")


class Removed(Value):
    """``$$REMOVE``: the field goes."""


def field_path(text: str) -> list[str]:
    """The parts of ``a.b`` out of ``$a.b``."""
    name = text[1:]
    if not name:
        raise bad("'$' by itself is not a valid FieldPath", 16872)
    parts = parts_of(name)
    if any(p.startswith("$") for p in parts):
        raise bad("FieldPath field names may not start with '$'.", 16410)
    return parts


def whole_of(root: Value) -> Value:
    return Value(root.whole(), root.type) if isinstance(root, Root) else root


def compile_expr(spec: object, root: Value, wide: bool = False) -> Value:
    """The value of an expression over a row."""
    again = lambda s: compile_expr(s, root, wide)
    if isinstance(spec, str) and spec.startswith("$$"):
        name, _, rest = spec[2:].partition(".")
        if name in ("ROOT", "CURRENT"):
            return aggregation_path(root, parts_of(rest)) if rest else whole_of(root)
        if name == "REMOVE":
            return Removed(F.lit(None), None)
        raise bad(f"Use of undefined variable: {name}", 17276)
    if isinstance(spec, str) and spec.startswith("$"):
        return aggregation_path(root, field_path(spec))
    if isinstance(spec, list):
        parts = [again(x) for x in spec]
        kind = widest([p.type for p in parts]) or T.StringType()
        return Value(F.array(*[p.col.cast(kind) for p in parts]) if parts else F.array().cast(T.ArrayType(kind)), T.ArrayType(kind))
    if not isinstance(spec, dict):
        return literal(spec)
    names = list(spec)
    if any(n.startswith("$") for n in names):
        if len(names) != 1:
            raise bad(f"an expression specification must contain exactly one field, the name of the expression. Found {len(names)} fields", 15983)
        return _operator(names[0], spec[names[0]], again, wide)
    for n in names:
        if "." in n:
            raise bad("FieldPath field names may not contain '.'.", 16412)
    parts = {n: again(x) for n, x in spec.items()}
    parts = {n: v for n, v in parts.items() if not isinstance(v, Removed)}
    kinds = {n: v.type or T.StringType() for n, v in parts.items()}
    kinds = {n: T.StringType() if isinstance(k, T.NullType) else k for n, k in kinds.items()}
    return Value(F.struct(*[v.col.cast(kinds[n]).alias(n) for n, v in parts.items()]), T.StructType([T.StructField(n, kinds[n]) for n in parts]))


def _operator(op: str, arg: object, again: Callable[[object], Value], wide: bool) -> Value:
    if op == "$literal":
        return literal(arg)
    if op == "$cond":
        return _cond(arg, again)
    if op in DATE_PARTS:
        return _date_part(op, arg, again)
    if op not in ARITY:
        raise bad(f"unsupported expression operator '{op}' in v1", 168)
    args = arg if isinstance(arg, list) else [arg]
    n = ARITY[op]
    if n is not None and len(args) != n:
        raise bad(f"Expression {op} takes exactly {n} arguments. {len(args)} were passed in.", 16020)
    if op == "$ifNull" and len(args) < 2:
        raise bad(f"$ifNull needs at least two arguments, had: {len(args)}", 1257300)
    values = [again(a) for a in args]
    if op in WIDENED:
        return OPERATORS[op](values, wide)
    return OPERATORS[op](values)


def _number(v: Value) -> Column:
    """Integers as bigint, the rest as double."""
    if v.missing or isinstance(v.type, T.NullType):
        return F.lit(None).cast("bigint")
    if isinstance(v.type, T.DecimalType):
        return v.col.cast("double")
    return v.col.cast("bigint") if isinstance(v.type, INTEGERS) else v.col.cast("double")


def _kind(values: list[Value]) -> T.DataType:
    return T.DoubleType() if any(is_float(v.type) or isinstance(v.type, T.DecimalType) for v in values) else T.LongType()


def millis(v: Value) -> Column:
    return F.unix_millis(v.col.cast("timestamp"))


def _as_date(ms: Column) -> Value:
    return Value(F.timestamp_millis(ms).cast("timestamp_ntz"), T.TimestampNTZType())


def _nullish(v: Value) -> bool:
    return v.missing or isinstance(v.type, T.NullType)


def _fold(values: list[Value], kind: T.DataType, start: int, plain: Callable, tried: Callable, wide: bool) -> Value:
    """Combine numbers; ``wide``: the exact bigint where there is one, else the sum or product of doubles, as double."""
    whole = F.lit(start).cast(kind)
    for v in values:
        whole = (tried if wide and isinstance(kind, T.LongType) else plain)(whole, _number(v).cast(kind))
    if not (wide and isinstance(kind, T.LongType)):
        return Value(whole, kind)
    loose = F.lit(float(start))
    for v in values:
        loose = plain(loose, _number(v).cast("double"))
    return Value(F.coalesce(whole.cast("double"), loose), T.DoubleType())


def _add(values: list[Value], wide: bool = False) -> Value:
    dates = [v for v in values if class_of(v.type) == "date"]
    for v in values:
        if class_of(v.type) not in ("number", "date", "null"):
            raise bad(f"$add only supports numeric or date types, not {type_text(v.type)}", 16554)
    if len(dates) > 1:
        raise bad("only one date allowed in an $add expression", 16612)
    rest = [v for v in values if class_of(v.type) != "date"]
    total = _fold(rest, _kind(rest), 0, lambda a, b: a + b, F.try_add, wide and not dates)
    if dates:
        return _as_date(millis(dates[0]) + F.round(total.col).cast("bigint"))
    return total


def _multiply(values: list[Value], wide: bool = False) -> Value:
    for v in values:
        if class_of(v.type) not in ("number", "null"):
            raise bad(f"$multiply only supports numeric types, not {type_text(v.type)}", 16555)
    return _fold(values, _kind(values), 1, lambda a, b: a * b, F.try_multiply, wide)


def _subtract(values: list[Value], wide: bool = False) -> Value:
    a, b = values
    ca, cb = class_of(a.type), class_of(b.type)
    if "null" in (ca, cb):
        return Value(F.lit(None).cast("bigint"), T.LongType())
    if ca == "date" and cb == "date":
        return Value(millis(a) - millis(b), T.LongType())
    if ca == "date" and cb == "number":
        return _as_date(millis(a) - F.round(_number(b)).cast("bigint"))
    if ca != "number" or cb != "number":
        raise bad(f"can't $subtract {type_text(b.type)} from {type_text(a.type)}", 16556)
    kind = _kind(values)
    if wide and isinstance(kind, T.LongType):
        x, y = _number(a), _number(b)
        return Value(F.coalesce(F.try_subtract(x, y).cast("double"), x.cast("double") - y.cast("double")), T.DoubleType())
    return Value(_number(a).cast(kind) - _number(b).cast(kind), kind)


def _fails(code: int, msg: str, kind: str) -> Column:
    return F.raise_error(F.lit(f"{msg} [{code}]")).cast(kind)


def _divide(values: list[Value]) -> Value:
    a, b = values
    if any(class_of(v.type) not in ("number", "null") for v in values):
        raise bad(f"$divide only supports numeric types, not {type_text(a.type)} and {type_text(b.type)}", 16609)
    x, y = _number(a).cast("double"), _number(b).cast("double")
    return Value(F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, _fails(16608, "can't $divide by zero", "double")).otherwise(x / y), T.DoubleType())


def _mod(values: list[Value]) -> Value:
    a, b = values
    if any(class_of(v.type) not in ("number", "null") for v in values):
        raise bad(f"$mod only supports numeric types, not {type_text(a.type)} and {type_text(b.type)}", 16611)
    kind = _kind(values)
    x, y = _number(a).cast(kind), _number(b).cast(kind)
    return Value(F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, _fails(16610, "can't $mod by zero", kind.simpleString())).otherwise(x % y), kind)


def _compare(op: str) -> Callable[[list[Value]], Value]:
    """Comparison in the total order, always true or false: a missing field is below null, null below all others.
    Two fields without a value are equal; a field without one isn't equal to a null constant, but below it."""

    def build(values: list[Value]) -> Value:
        a, b = values
        null = lambda v: F.lit(True) if _nullish(v) else v.col.isNull()
        rank = lambda v: F.lit(1 if v.constant else 0) if v.constant or v.missing else F.lit(0)
        na, nb = null(a), null(b)
        ca, cb = class_of(a.type), class_of(b.type)
        if "null" in (ca, cb) or ca != cb:
            lower = RANK.get(ca, 0) < RANK.get(cb, 0)
            lt, eq = F.lit(lower), F.lit(False)
        else:
            lt = below(a, b)
            eq = below(a, b, True) & ~lt if is_float(a.type) or is_float(b.type) else below(a, b, True) & below(b, a, True) if ca not in ("object", "array") else a.col == b.col
        less = F.when(na & nb, rank(a) < rank(b)).when(na, F.lit(True)).when(nb, F.lit(False)).otherwise(lt)
        same = F.when(na & nb, rank(a) == rank(b)).when(na | nb, F.lit(False)).otherwise(eq)
        out = {"$eq": same, "$ne": ~same, "$lt": less, "$lte": less | same, "$gt": ~(less | same), "$gte": ~less}[op]
        return Value(out, T.BooleanType())

    return build


def truthy(v: Value) -> Column:
    """False for false, zero and no value; true for all else, empty strings and arrays too."""
    if _nullish(v):
        return F.lit(False)
    c = class_of(v.type)
    if c == "bool":
        return F.coalesce(v.col, F.lit(False))
    if c == "number":
        return F.coalesce(v.col != 0, F.lit(False))
    return v.col.isNotNull()


def _and(values: list[Value]) -> Value:
    out = F.lit(True)
    for v in values:
        out = out & truthy(v)
    return Value(out, T.BooleanType())


def _or(values: list[Value]) -> Value:
    out = F.lit(False)
    for v in values:
        out = out | truthy(v)
    return Value(out, T.BooleanType())


def _cond(arg: object, again: Callable[[object], Value]) -> Value:
    if isinstance(arg, dict):
        for name in arg:
            if name not in ("if", "then", "else"):
                raise bad(f"Unrecognized parameter to $cond: {name}", 17083)
        for name, code in (("if", 17080), ("then", 17081), ("else", 17082)):
            if name not in arg:
                raise bad(f"Missing '{name}' parameter to $cond", code)
        arg = [arg["if"], arg["then"], arg["else"]]
    args = arg if isinstance(arg, list) else [arg]
    if len(args) != 3:
        raise bad(f"Expression $cond takes exactly 3 arguments. {len(args)} were passed in.", 16020)
    test, yes, no = map(again, args)
    kind = widest([yes.type, no.type]) or T.NullType()
    return Value(F.when(truthy(test), yes.col.cast(kind)).otherwise(no.col.cast(kind)), kind)


def _if_null(values: list[Value]) -> Value:
    kind = widest([v.type for v in values])
    if kind is None:
        return missing()
    return Value(F.coalesce(*[v.col.cast(kind) for v in values]), kind)


def _concat(values: list[Value]) -> Value:
    for v in values:
        if class_of(v.type) not in ("string", "null"):
            raise bad(f"$concat only supports strings, not {type_text(v.type)}", 16702)
    return Value(F.concat(*[v.col.cast("string") for v in values]) if values else F.lit(""), T.StringType())


def date_text(col: Column) -> Column:
    return F.date_format(col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _case(src: str, dst: str) -> Callable[[list[Value]], Value]:
    def build(values: list[Value]) -> Value:
        (v,) = values
        c = class_of(v.type)
        if c not in ("string", "number", "date", "null"):
            raise bad(f"can't convert from BSON type {type_text(v.type)} to String", 16007)
        text = date_text(v.col) if c == "date" else v.col.cast("string")
        return Value(F.translate(F.coalesce(text, F.lit("")), src, dst), T.StringType())

    return build


def _size(values: list[Value]) -> Value:
    (v,) = values
    say = "The argument to $size must be an array. Type of argument was: "
    if class_of(v.type) != "array":
        if _nullish(v):
            return Value(_fails(17124, say + "missing", "bigint"), T.LongType())
        raise bad(say + type_text(v.type), 17124)
    return Value(F.when(v.col.isNull(), _fails(17124, say + "missing", "bigint")).otherwise(F.size(v.col).cast("bigint")), T.LongType())


def _date_part(op: str, arg: object, again: Callable[[object], Value]) -> Value:
    zone: object = None
    if isinstance(arg, dict) and not any(k.startswith("$") for k in arg):
        for name in arg:
            if name not in ("date", "timezone"):
                raise bad(f'unrecognized option to {op}: "{name}"', 40535)
        if "date" not in arg:
            raise bad(f"missing 'date' argument to {op}", 40539)
        arg, zone = arg["date"], arg.get("timezone")
    elif isinstance(arg, list):
        if len(arg) != 1:
            raise bad(f"Expression {op} takes exactly 1 arguments. {len(arg)} were passed in.", 16020)
        arg = arg[0]
    v = again(arg)
    if _nullish(v):
        return Value(F.lit(None).cast("int"), T.IntegerType())
    if class_of(v.type) != "date":
        raise bad(f"can't convert from BSON type {type_text(v.type)} to Date", 16006)
    when = v.col.cast("timestamp")
    if zone is not None:
        if not isinstance(zone, str):
            raise bad(f"timezone must evaluate to a string, found {type_name(zone)}", 40517)
        when = F.from_utc_timestamp(when, _zone(zone))
    return Value(DATE_PARTS[op](when), T.IntegerType())


def _zone(name: str) -> str:
    if OFFSET.match(name):
        digits = name[1:].replace(":", "").ljust(4, "0")
        return f"{name[0]}{digits[:2]}:{digits[2:]}"
    from zoneinfo import ZoneInfo

    try:
        ZoneInfo(name)
    except Exception as e:
        raise QueryError(40485, f'unrecognized time zone identifier: "{name}"') from e
    return name


WIDENED = ("$add", "$subtract", "$multiply")
OPERATORS: dict[str, Callable[..., Value]] = {
    "$add": _add, "$multiply": _multiply, "$subtract": _subtract, "$divide": _divide, "$mod": _mod,
    **{op: _compare(op) for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")},
    "$and": _and, "$or": _or, "$not": lambda v: Value(~truthy(v[0]), T.BooleanType()), "$ifNull": _if_null, "$concat": _concat,
    "$toLower": _case(UPPER, LOWER), "$toUpper": _case(LOWER, UPPER), "$size": _size,
}
