"""Filter documents, compiled to one boolean column that is never null.

Each operator on an array field has its own witness, so ``{a: {$gt: 1, $lt: 5}}`` may be met by two elements; only
``$elemMatch`` shares one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import BAD_REGEX, BAD_REGEX_OPTIONS, bad
from tessera.functions.ejson import MAX_KEY, MIN_KEY, UNDEFINED, Regex
from tessera.functions.values import INTEGERS, Value, any_match, class_of, is_float, literal

# Operators that are refused by name, and type aliases with their codes.
REFUSED_TOP = ("$where", "$expr", "$text", "$jsonSchema", "$sampleRate")
REFUSED = ("$bitsAllClear", "$bitsAllSet", "$bitsAnyClear", "$bitsAnySet")
ALIASES = {"double": 1, "string": 2, "object": 3, "array": 4, "binData": 5, "undefined": 6, "objectId": 7, "bool": 8, "date": 9, "null": 10, "regex": 11, "dbPointer": 12, "javascript": 13, "symbol": 14, "javascriptWithScope": 15, "int": 16, "timestamp": 17, "long": 18, "decimal": 19, "minKey": -1, "maxKey": 127}
GEO = ("$geoWithin", "$geoIntersects")
NEAR = ("$near", "$nearSphere")

#: Whether a condition may be null for false. Where no negation lies above, it may, and the scan can then prune by it.
_LOOSE: ContextVar[bool] = ContextVar("loose", default=False)


@contextmanager
def _null_is_false(allowed: bool) -> Iterator[None]:
    token = _LOOSE.set(allowed)
    try:
        yield
    finally:
        _LOOSE.reset(token)


def where_filter(spec: object, root: Value) -> Column:
    """``compile_filter`` for a WHERE, which takes null for false: comparisons stay bare, so that they reach the scan."""
    with _null_is_false(True):
        return compile_filter(spec, root)


def _never(build: Callable[[], Column]) -> Column:
    """The negation of a condition that is then never null."""
    with _null_is_false(False):
        return ~build()


def compile_filter(spec: object, root: Value) -> Column:
    """All of a filter document's conditions hold. An empty document holds for every row."""
    if not isinstance(spec, dict):
        raise bad("the match filter must be an expression in an object", 15959)
    out = F.lit(True)
    for name, arg in spec.items():
        out = out & _top(name, arg, root)
    return out

def _top(name: str, arg: object, root: Value) -> Column:
    if name in ("$and", "$or", "$nor"):
        return logical(name, arg, lambda x: compile_filter(x, root))
    if name == "$comment":
        return F.lit(True)
    if name in ("$alwaysTrue", "$alwaysFalse"):
        return F.lit(name == "$alwaysTrue")
    if name in REFUSED_TOP:
        raise bad(f"unsupported query operator '{name}' in v1")
    if name.startswith("$"):
        raise bad(f"unknown top level operator: {name}")
    return field_condition(name.split("."), arg, root)

def logical(op: str, arg: object, build: Callable[[object], Column]) -> Column:
    if not isinstance(arg, list):
        raise bad(f"{op} must be an array")
    if not arg:
        raise bad("$and/$or/$nor must be a nonempty array")
    if not all(isinstance(x, dict) for x in arg):
        raise bad("$or/$and/$nor entries need to be full objects")

    def joined() -> Column:
        parts = [build(x) for x in arg]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if op == "$and" else out | p
        return out

    return _never(joined) if op == "$nor" else joined()

def is_operators(arg: object) -> bool:
    return isinstance(arg, dict) and bool(arg) and next(iter(arg)).startswith("$")

def field_condition(path: list[str], arg: object, root: Value) -> Column:
    if not is_operators(arg):
        return any_match(root, path, regex(arg) if isinstance(arg, Regex) else equals(arg))
    ops = dict(arg)
    if "$options" in ops and "$regex" not in ops:
        raise bad("$options needs a $regex")
    if "$regex" in ops:
        ops["$regex"] = _regex_of(ops["$regex"], ops.pop("$options", None))
    out = F.lit(True)
    for op, x in ops.items():
        out = out & _condition(op, x, path, root)
    return out

def _condition(op: str, x: object, path: list[str], root: Value) -> Column:
    any_of = lambda test: any_match(root, path, test)
    if op == "$eq":
        return any_of(regex(x) if isinstance(x, Regex) else equals(x))
    if op == "$ne":
        if isinstance(x, Regex):
            raise bad("Can't have regex as arg to $ne.")
        return _never(lambda: any_of(equals(x)))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return any_of(ordered(op, x))
    if op in ("$in", "$nin"):
        return any_of(among(op, x)) if op == "$in" else _never(lambda: any_of(among(op, x)))
    if op == "$exists":
        there = any_of(lambda v: F.lit(False) if v.missing else v.col.isNotNull())
        return there if x not in (False, 0, None) else ~there
    if op == "$type":
        return any_of(typed(x))
    if op == "$size":
        return any_of(sized(x))
    if op == "$mod":
        return any_of(modulo(x))
    if op == "$regex":
        return any_of(regex(x))
    if op == "$not":
        if isinstance(x, Regex):
            return _never(lambda: any_of(regex(x)))
        if not isinstance(x, dict):
            raise bad("$not needs a regex or a document")
        if not x:
            raise bad("$not cannot be empty")
        if not is_operators(x):
            raise bad("$not needs a regex or a document")
        return _never(lambda: field_condition(path, x, root))
    if op == "$all":
        return _all(x, path, root)
    if op == "$elemMatch":
        return any_of(elem_match(x))
    if op in GEO:
        from tessera.functions.geojson import geo_condition

        return any_of(lambda v: F.coalesce(geo_condition(op, x, v), F.lit(False)))
    if op in NEAR:
        raise bad("$geoNear, $near, and $nearSphere are not allowed in this context")
    if op in ("$maxDistance", "$minDistance"):
        raise bad("$maxDistance and $minDistance are only valid with $near or $nearSphere")
    if op in REFUSED or op in REFUSED_TOP:
        raise bad(f"unsupported query operator '{op}' in v1")
    raise bad(f"unknown operator: {op}")

# ---- tests of one value. Each takes the value at a path's end and gives a column that isn't null.

def spread(test: Callable[[Value], Column]) -> Callable[[Value], Column]:
    """The value itself or, if it is an array, any of its elements."""

    def both(v: Value) -> Column:
        if v.missing or not isinstance(v.type, T.ArrayType):
            return test(v)
        inner = v.type.elementType
        return test(v) | F.coalesce(F.exists(v.col, lambda x: test(Value(x, inner))), F.lit(False))

    return both

def _false(c: Column) -> Column:
    return c if _LOOSE.get() else F.coalesce(c, F.lit(False))

def equals(x: object) -> Callable[[Value], Column]:
    def test(v: Value) -> Column:
        if x is None:
            return F.lit(True) if v.missing else v.col.isNull()
        if v.missing or x in (UNDEFINED, MIN_KEY, MAX_KEY):
            return F.lit(False)
        return _false(same(v, x))

    return spread(test)

def same(v: Value, x: object) -> Column:
    """Equal to a constant of the value's class; else false."""
    if isinstance(x, Decimal):
        return v.col.cast("decimal(38,18)") == F.lit(x) if class_of(v.type) == "number" else F.lit(False)
    c = literal(x)
    if class_of(v.type) != class_of(c.type):
        return F.lit(False)
    if isinstance(x, dict):
        names = v.type.fieldNames()
        if names[: len(x)] != list(x) and [n for n in names if n in x] != list(x):
            return F.lit(False)
        out = F.lit(True)
        for n in names:
            part = Value(v.col[n], v.type[n].dataType)
            out = out & (_false(same(part, x[n])) if x.get(n) is not None else part.col.isNull())
        return out & v.col.isNotNull()
    if isinstance(x, list):
        inner = v.type.elementType
        out = F.size(v.col) == len(x)
        for i, e in enumerate(x):
            at = Value(F.get(v.col, F.lit(i)), inner)
            out = out & (at.col.isNull() if e is None else _false(same(at, e)))
        return out
    if is_float(v.type) and isinstance(x, float) and math.isnan(x):
        return F.isnan(v.col)
    if class_of(v.type) == "date":
        return v.col == c.col.cast(v.type)
    if isinstance(v.type, INTEGERS) and isinstance(x, float):
        return v.col == int(x) if x.is_integer() and abs(x) < 2**63 else F.lit(False)
    return v.col == c.col

def ordered(op: str, x: object) -> Callable[[Value], Column]:
    def test(v: Value) -> Column:
        if x is MIN_KEY or x is MAX_KEY:
            up = op in ("$gt", "$gte")
            return F.lit(up if x is MIN_KEY else not up)
        if x is None:
            if op in ("$gt", "$lt"):
                return F.lit(False)
            return F.lit(True) if v.missing else v.col.isNull()
        if v.missing:
            return F.lit(False)
        c = Value(F.lit(x), T.DecimalType(38, 18)) if isinstance(x, Decimal) else literal(x)
        if class_of(v.type) != class_of(c.type) or class_of(c.type) == "null":
            return F.lit(False)
        nan = isinstance(x, float) and math.isnan(x)
        if nan:
            return _false(F.isnan(v.col)) if op in ("$gte", "$lte") and is_float(v.type) else F.lit(False)
        if class_of(v.type) == "date":
            c = Value(c.col.cast(v.type), v.type)
        if isinstance(v.type, T.StructType) or isinstance(v.type, T.ArrayType):
            c = Value(c.col.cast(v.type), v.type)
        out = {"$gt": v.col > c.col, "$gte": v.col >= c.col, "$lt": v.col < c.col, "$lte": v.col <= c.col}[op]
        if is_float(v.type) and op in ("$gt", "$gte"):
            out = out & ~F.isnan(v.col)
        return _false(out)

    return spread(test)

def among(op: str, xs: object) -> Callable[[Value], Column]:
    if not isinstance(xs, list):
        raise bad(f"{op} needs an array")
    if any(is_operators(x) for x in xs):
        raise bad(f"cannot nest $ under {op}")

    def test(v: Value) -> Column:
        out = F.lit(False)
        scalars = []
        for x in xs:
            if x is None:
                out = out | (F.lit(True) if v.missing else v.col.isNull())
            elif v.missing:
                continue
            elif isinstance(x, Regex):
                out = out | regex_plain(x)(v)
            elif isinstance(x, (list, dict)) or (isinstance(x, float) and math.isnan(x)) or isinstance(x, Decimal):
                out = out | _false(same(v, x))
            elif class_of(literal(x).type) == class_of(v.type) and not (isinstance(v.type, INTEGERS) and isinstance(x, float)):
                scalars.append(literal(x).col.cast(v.type) if class_of(v.type) == "date" else literal(x).literal)
            else:
                out = out | _false(same(v, x))
        if scalars:
            out = out | _false(v.col.isin(*scalars))
        return out

    return spread(test)

def typed(x: object) -> Callable[[Value], Column]:
    wanted = x if isinstance(x, list) else [x]
    if not wanted:
        raise bad("$type must match at least one type")
    codes: set[int] = set()
    for t in wanted:
        if isinstance(t, str):
            if t == "number":
                codes |= {1, 16, 18, 19}
            elif t in ALIASES:
                codes.add(ALIASES[t])
            else:
                raise bad(f"Unknown type name alias: {t}")
        elif isinstance(t, (int, float)) and not isinstance(t, bool):
            if t != int(t):
                raise bad(f"Invalid numerical type code: {t}")
            if int(t) not in ALIASES.values():
                raise bad(f"Invalid numerical type code: {int(t)}")
            codes.add(int(t))
        else:
            raise bad("type must be represented as a number or a string")

    def code_of(kind: T.DataType) -> int:
        if isinstance(kind, T.LongType):
            return 18
        if isinstance(kind, INTEGERS):
            return 16
        if isinstance(kind, T.DecimalType):
            return 19
        return {"number": 1, "string": 2, "object": 3, "array": 4, "binary": 5, "bool": 8, "date": 9, "null": 10}[class_of(kind)]

    def test(v: Value) -> Column:
        if v.missing:
            return F.lit(False)
        return v.col.isNotNull() if code_of(v.type) in codes else F.lit(False)

    return spread(test)

def sized(x: object) -> Callable[[Value], Column]:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise bad("$size needs a number")
    if x != int(x):
        raise bad("$size must be a whole number")
    if x < 0:
        raise bad("$size may not be negative")
    return lambda v: _false(F.size(v.col) == int(x)) & v.col.isNotNull() if isinstance(v.type, T.ArrayType) else F.lit(False)

def modulo(x: object) -> Callable[[Value], Column]:
    if not isinstance(x, list):
        raise bad("malformed mod, needs to be an array")
    if len(x) != 2:
        raise bad("malformed mod, not enough elements" if len(x) < 2 else "malformed mod, too many elements")
    for what, n in zip(("divisor", "remainder"), x):
        if isinstance(n, bool) or not isinstance(n, (int, float)):
            raise bad(f"malformed mod, {what} not a number")
        if isinstance(n, float) and not math.isfinite(n):
            raise bad(f"malformed mod, {what} value is invalid :: caused by :: {n}")
    d, r = int(x[0]), int(x[1])
    if d == 0:
        raise bad("divisor cannot be 0")

    def test(v: Value) -> Column:
        if v.missing or class_of(v.type) != "number":
            return F.lit(False)
        c = v.col
        if is_float(v.type):
            c = F.when(~F.isnan(c) & (F.abs(c) < 2.0**63), c)
        return _false(c.cast("bigint") % F.lit(d).cast("bigint") == r)

    return spread(test)

#: Escapes, classes, look-around, atomic groups and possessive repeats, in reading order.
REGEX_PARTS = re.compile(r"\\(.)|\[\^?\]?(?:\\.|[^\]])*\]|\(\?(?:<?[=!]|>)|[*+?}]\+", re.DOTALL)


# Named classes and their Java names.
JAVA_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}


def refused_part(pattern: str) -> str | None:
    """The first part of a pattern that isn't supported: look-around, a back-reference, an atomic or possessive repeat."""
    for m in REGEX_PARTS.finditer(pattern):
        if m.group(1) is not None and m.group(1) not in "123456789" or m.group()[0] == "[":
            continue
        return m.group()
    return None


def _regex_of(x: object, options: object) -> Regex:
    if not isinstance(x, (str, Regex)):
        raise bad("$regex has to be a string")
    if options is not None and not isinstance(options, str):
        raise bad("$options has to be a string")
    if isinstance(x, Regex):
        if options is not None and x.options:
            raise bad("options set in both $regex and $options")
        return Regex(x.pattern, options if options is not None else x.options)
    return Regex(x, options or "")

def java_regex(x: Regex) -> str:
    """The pattern with inline flags. Look-around, back-references and possessive repeats are refused."""
    for o in x.options:
        if o not in "imsxu":
            raise bad(f"invalid flag in regex options: {o}", BAD_REGEX_OPTIONS)
    if "\0" in x.pattern:
        raise bad("Regular expression cannot contain an embedded null byte", BAD_REGEX)
    if refused := refused_part(x.pattern):
        raise bad(f"Regular expression is invalid: {refused} is not supported", BAD_REGEX)
    flags = "d" + "".join({"i": "iu"}.get(o, o) for o in dict.fromkeys(x.options) if o in "ims")
    return f"(?{flags})" + _java_parts(x.pattern.replace("(?P<", "(?<"), "m" in x.options, "x" in x.options)

def _java_parts(pattern: str, lines: bool, spaced: bool) -> str:
    """The pattern in Java's writing: an end is the very end of the text, or of a line with ``lines``; within a class
    only escapes, ranges and named classes are special; blanks and comments go with ``spaced``, but not within classes."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            out.append(pattern[i : i + 2])
            i += 2
        elif c == "[":
            end, part = _java_class(pattern, i)
            out.append(part)
            i = end
        elif spaced and c.isspace():
            i += 1
        elif spaced and c == "#":
            while i < n and pattern[i] != "\n":
                i += 1
        else:
            out.append(r"\z" if c == "$" and not lines else c)
            i += 1
    return "".join(out)

def _java_class(pattern: str, at: int) -> tuple[int, str]:
    """Where a class that begins at ``at`` ends, and its Java form."""
    out, i, n = ["["], at + 1, len(pattern)
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < n and (pattern[i] != "]" or first):
        named = re.match(r"\[:(\^?)([a-z]+):\]", pattern[i:])
        if named and named.group(2) in JAVA_CLASSES:
            out.append(r"\%s{%s}" % ("P" if named.group(1) else "p", JAVA_CLASSES[named.group(2)]))
            i += named.end()
        elif pattern[i] == "\\" and i + 1 < n:
            out.append(pattern[i : i + 2])
            i += 2
        else:
            out.append("\\" + pattern[i] if pattern[i] in "[]&# " else pattern[i])
            i += 1
        first = False
    if i >= n:
        raise bad("Regular expression is invalid: missing closing ]", BAD_REGEX)
    return i + 1, "".join(out) + "]"

def literal_prefix(x: Regex) -> str:
    """Characters that every match of an anchored pattern begins with, for the scan to prune by."""
    if not x.pattern.startswith("^") or any(o in "imx" for o in x.options) or "|" in x.pattern:
        return ""
    m = re.match(r"\^((?:[A-Za-z0-9 _/:,@%=~&#'\"<>!;-])*)", x.pattern)
    prefix = m.group(1)
    return prefix[:-1] if prefix and x.pattern[m.end() :][:1] in ("*", "?", "{") else prefix

def regex_plain(x: Regex) -> Callable[[Value], Column]:
    pattern, prefix = java_regex(x), literal_prefix(x)

    def test(v: Value) -> Column:
        if v.missing or not isinstance(v.type, T.StringType):
            return F.lit(False)
        out = v.col.rlike(pattern)
        return _false(v.col.startswith(prefix) & out if prefix else out)

    return test

def regex(x: Regex) -> Callable[[Value], Column]:
    return spread(regex_plain(x))

def _all(xs: object, path: list[str], root: Value) -> Column:
    if not isinstance(xs, list):
        raise bad("$all needs an array")
    if not xs:
        return F.lit(False)
    nested = [is_operators(x) and "$elemMatch" in x for x in xs]
    if any(nested) and not all(nested):
        raise bad("$all/$elemMatch has to be consistent")
    out = F.lit(True)
    for x, elem in zip(xs, nested):
        if elem:
            out = out & any_match(root, path, elem_match(x["$elemMatch"]))
        elif is_operators(x):
            raise bad("no $ expressions in $all")
        else:
            out = out & any_match(root, path, regex(x) if isinstance(x, Regex) else equals(x))
    return out

def elem_match(x: object) -> Callable[[Value], Column]:
    if not isinstance(x, dict):
        raise bad("$elemMatch needs an Object")
    whole = not is_operators(x) or next(iter(x)) in ("$and", "$or", "$nor")

    def test(v: Value) -> Column:
        if not isinstance(v.type, T.ArrayType):
            return F.lit(False)
        inner = v.type.elementType

        def one(e: Column) -> Column:
            at = Value(e, inner)
            if whole:
                return compile_filter(x, at) if isinstance(inner, T.StructType) else F.lit(False)
            return _element(x, at)

        return _false(F.exists(v.col, one))

    return test

def _element(ops: dict, at: Value) -> Column:
    """One element meets every operator: no second witness, so arrays aren't spread."""
    ops = dict(ops)
    if "$options" in ops and "$regex" not in ops:
        raise bad("$options needs a $regex")
    if "$regex" in ops:
        ops["$regex"] = _regex_of(ops["$regex"], ops.pop("$options", None))
    out = F.lit(True)
    for op, x in ops.items():
        if not op.startswith("$"):
            raise bad(f"unknown operator: {op}")
        if op in ("$near", "$nearSphere", *GEO):
            raise bad(f"{op} is not allowed inside $elemMatch value conditions")
        if op == "$not" and isinstance(x, dict):
            if not x:
                raise bad("$not cannot be empty")
            out = out & _never(lambda x=x: _element(x, at))
        else:
            out = out & _condition(op, x, [], at)
    return out

__all__ = ["compile_filter", "missing", "parts_of", "below", "type_name"]
