"""Updates as transforms: the rows that a filter matches are rewritten, the rest pass.

A column has one type, so a value of another class can't be set, and an unset field is NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CONFLICT, DOLLAR_NAME, EMPTY_NAME, FAILED_TO_PARSE, IMMUTABLE, NOT_SINGLE, NOT_VIABLE, TYPE_MISMATCH, bad
from tessera.functions import ejson
from tessera.functions.ejson import Regex, type_name
from tessera.functions.filters import _element, compile_filter, equals, is_operators, same
from tessera.functions.values import INTEGERS, Root, Value, child, class_of, literal, plain_path, type_text, widest
from tessera.operators.stages import ID, quoted, start

# The operators.
OPERATORS = ("$set", "$setOnInsert", "$unset", "$inc", "$mul", "$min", "$max", "$currentDate", "$rename", "$push", "$addToSet", "$pop", "$pull", "$pullAll")
MOST_PAD = 1_500_000

Change = Callable[[Value], Value]


def parse_update(spec: object) -> tuple[dict | None, list[tuple[str, str, object]]]:
    """A replacement document, or (operator, path, argument) by path. Paths may not lie on one another."""
    spec = ejson.parse(spec)
    if not isinstance(spec, dict):
        raise bad("an update must be a document", FAILED_TO_PARSE)
    if not any(k.startswith("$") for k in spec):
        return spec, []
    out: list[tuple[str, str, object]] = []
    for op, fields in spec.items():
        if op == "$bit":
            raise bad("unsupported update operator '$bit' in v1")
        if op not in OPERATORS:
            if not op.startswith("$"):
                raise bad(f"The dollar ($) prefixed field '{next(k for k in spec if k.startswith('$'))}' in '{next(k for k in spec if k.startswith('$'))}' is not valid for storage.", DOLLAR_NAME)
            raise bad(f"Unknown modifier: {op}. Expected a valid update modifier or pipeline-style update specified as an array", FAILED_TO_PARSE)
        if not isinstance(fields, dict):
            raise bad(f"Modifiers operate on fields but we found type {type_name(fields)} instead. For example: {{$mod: {{<field>: ...}}}} not {{{op}: {ejson.format(fields, False)}}}", FAILED_TO_PARSE)
        for path, arg in fields.items():
            _check_path(path)
            if op == "$rename":
                if not isinstance(arg, str):
                    raise bad(f"The 'to' field for $rename must be a string: {path}: {ejson.format(arg, False)}")
                _check_path(arg)
                if arg == path:
                    raise bad(f'The source and target field for $rename must differ: {path}: "{arg}"')
                if arg.startswith(path + ".") or path.startswith(arg + "."):
                    raise bad(f'The source and target field for $rename must not be on the same path: {path}: "{arg}"')
            out.append((op, path, arg))
    claimed: list[str] = []
    for op, path, arg in out:
        for p in [path, arg] if op == "$rename" else [path]:
            for q in claimed:
                short, long = sorted((p, q), key=len)
                if long == short or long.startswith(short + "."):
                    raise bad(f"Updating the path '{p}' would create a conflict at '{short}'", CONFLICT)
            claimed.append(p)
    return None, sorted(out, key=lambda x: x[1])


def _check_path(path: str) -> None:
    if not path:
        raise bad("An empty update path is not valid.", EMPTY_NAME)
    for part in path.split("."):
        if not part:
            raise bad(f"The update path '{path}' contains an empty field name, which is not allowed.", EMPTY_NAME)
        if part == "$" or part.startswith("$["):
            raise bad(f"positional update operators are not supported in v1: '{path}'")
        if part.startswith("$"):
            raise bad(f"The dollar ($) prefixed field '{part}' in '{path}' is not valid for storage.", DOLLAR_NAME)


# ---- what an operator does to one value


def _number_of(op: str, path: str, x: object) -> Value:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise bad(f"Cannot {'increment' if op == '$inc' else 'multiply'} with non-numeric argument: {{{path}: {ejson.format(x, False)}}}", TYPE_MISMATCH)
    return literal(x)


def change_of(op: str, path: str, x: object, now: datetime) -> Change:
    """How ``op`` changes the value at a path."""
    if op in ("$set", "$setOnInsert"):
        return lambda v: _as(v, literal(x))
    if op == "$unset":
        return lambda v: Value(F.lit(None).cast(v.type) if not v.missing else F.lit(None), v.type)
    if op in ("$inc", "$mul"):
        n = _number_of(op, path, x)

        def arithmetic(v: Value) -> Value:
            if not v.missing and class_of(v.type) != "number":
                raise bad(f"Cannot apply {op} to a value of non-numeric type. The field '{path}' has non-numeric type {type_text(v.type)}", TYPE_MISMATCH)
            kind = T.LongType() if (v.missing or isinstance(v.type, INTEGERS)) and isinstance(n.type, INTEGERS) else T.DoubleType()
            old, by = (F.lit(None) if v.missing else v.col).cast(kind), n.col.cast(kind)
            return Value(F.coalesce(old + by if op == "$inc" else old * by, by if op == "$inc" else F.lit(0).cast(kind)), kind)

        return arithmetic
    if op in ("$min", "$max"):

        def extreme(v: Value) -> Value:
            new = _as(v, literal(x))
            if v.missing:
                return new
            return Value((F.least if op == "$min" else F.greatest)(v.col.cast(new.type), new.col), new.type)

        return extreme
    if op == "$currentDate":
        if isinstance(x, dict):
            if x.get("$type") not in ("date", "timestamp"):
                raise bad("The '$type' string field is required to be 'date' or 'timestamp': {$currentDate: {field : {$type: 'date'}}}")
        elif not isinstance(x, bool):
            raise bad(f"{type_name(x)} is not valid type for $currentDate. Please use a boolean ('true') or a $type expression ({{$type: 'timestamp/date'}}).")
        return lambda v: _as(v, literal(now))
    if op == "$push":
        return _push(path, x)
    if op == "$addToSet":
        return _add_to_set(path, x)
    if op == "$pop":
        if isinstance(x, bool) or x not in (1, -1):
            raise bad(f"$pop expects 1 or -1, found: {ejson.format(x, False)}", FAILED_TO_PARSE)

        def pop(v: Value) -> Value:
            if v.missing:
                return v
            if not isinstance(v.type, T.ArrayType):
                raise bad(f"Path '{path}' contains an element of non-array type '{type_text(v.type)}'")
            n = F.greatest(F.size(v.col) - 1, F.lit(0))
            return Value(F.when(v.col.isNotNull(), F.slice(v.col, F.lit(1) if x == 1 else F.lit(2), n)), v.type)

        return pop
    if op == "$pullAll" and not isinstance(x, list):
        raise bad(f"$pullAll requires an array argument but was given a {type_name(x)}", FAILED_TO_PARSE)

    def pull(v: Value) -> Value:
        if v.missing:
            return v
        if not isinstance(v.type, T.ArrayType):
            raise bad(f"Cannot apply {op} to a non-array value")
        inner = v.type.elementType

        def goes(e: Column) -> Column:
            at = Value(e, inner)
            if op == "$pullAll":
                out = F.lit(False)
                for y in x:
                    out = out | (e.isNull() if y is None else F.coalesce(same(at, y), F.lit(False)))
                return out
            if isinstance(x, Regex):
                return _element({"$regex": x}, at)
            if is_operators(x):
                return _element(x, at)
            if isinstance(x, dict):
                return compile_filter(x, at) if isinstance(inner, T.StructType) else F.lit(False)
            return equals(x)(at)

        return Value(F.filter(v.col, lambda e: ~goes(e)), v.type)

    return pull


def _as(v: Value, new: Value) -> Value:
    """A new value in the type that holds it and the old one."""
    if v.missing:
        return new if not isinstance(new.type, T.NullType) else Value(new.col.cast("string"), T.StringType())
    if isinstance(new.type, T.NullType):
        return Value(F.lit(None).cast(v.type), v.type)
    if isinstance(v.type, T.StructType) and isinstance(new.type, T.StructType) and v.type != new.type:
        fields = {n: child(new, n) for n in v.type.fieldNames()} | {n: child(new, n) for n in new.type.fieldNames()}
        typed = {n: _as(child(v, n), f) if not f.missing else Value(F.lit(None).cast(v.type[n].dataType), v.type[n].dataType) for n, f in fields.items()}
        return Value(F.struct(*[f.col.alias(n) for n, f in typed.items()]), T.StructType([T.StructField(n, f.type) for n, f in typed.items()]))
    if class_of(v.type) == "date" == class_of(new.type):
        return Value(new.col.cast(v.type), v.type)
    kind = v.type if isinstance(v.type, INTEGERS) and isinstance(new.type, INTEGERS) and not isinstance(new.type, T.LongType) else widest([v.type, new.type])
    return Value(new.col.cast(kind), kind)


def _array_of(v: Value, items: list[object], path: str, say: str) -> tuple[Column, Column, T.ArrayType]:
    """The old array (empty if missing), the new items, and their type."""
    new = literal(items)
    if v.missing:
        return F.array().cast(new.type), new.col, new.type
    if not isinstance(v.type, T.ArrayType):
        raise bad(say.format(path=path, type=type_text(v.type)))
    if items:
        inner = _as(Value(F.lit(None), v.type.elementType), Value(F.lit(None), new.type.elementType)).type
    else:
        inner = v.type.elementType
    kind = T.ArrayType(inner)
    old = F.coalesce(v.col.cast(kind), F.array().cast(kind))
    added = F.transform(new.col, lambda e: _as(Value(F.lit(None), inner), Value(e, new.type.elementType)).col) if items else F.array().cast(kind)
    return old, added, kind


def _push(path: str, x: object) -> Change:
    each, position, slice_, sort = [x], None, None, None
    if isinstance(x, dict) and "$each" in x:
        for name in x:
            if name not in ("$each", "$position", "$slice", "$sort"):
                raise bad(f"Unrecognized clause in $push: {name}")
        each = x["$each"]
        if not isinstance(each, list):
            raise bad(f"The argument to $each in $push must be an array but it was of type: {type_name(each)}")
        position, slice_, sort = x.get("$position"), x.get("$slice"), x.get("$sort")
        for name, n in (("$position", position), ("$slice", slice_)):
            if n is not None and (isinstance(n, bool) or not isinstance(n, (int, float)) or n != int(n)):
                raise bad(f"The value for {name} must be an integer value but was given type: {type_name(n)}")
        ways = [sort] if not isinstance(sort, dict) else list(sort.values())
        if sort is not None and (not ways or any(isinstance(w, bool) or w not in (1, -1) for w in ways)):
            raise bad("The $sort is invalid: use 1/-1 to sort the whole element, or {field:1/-1} to sort embedded fields")

    def push(v: Value) -> Value:
        old, new, kind = _array_of(v, each, path, "The field '{path}' must be an array but is of type {type}")
        if position is None:
            out = F.concat(old, new)
        else:
            p = int(position)
            at = F.least(F.lit(p), F.size(old)) if p >= 0 else F.greatest(F.size(old) + p, F.lit(0))
            out = F.concat(F.slice(old, F.lit(1), at), new, F.slice(old, at + 1, F.greatest(F.size(old) - at, F.lit(0))))
        if sort is not None:
            out = _sorted(out, kind.elementType, sort)
        if slice_ is not None:
            n = int(slice_)
            out = F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n, F.lit(0)) + 1, F.least(F.lit(-n), F.size(out)))
        return Value(out, kind)

    return push


def _sorted(col: Column, inner: T.DataType, sort: object) -> Column:
    """Elements in order, by themselves or by their fields; what compares equal keeps its order."""
    keys = [(None, sort)] if not isinstance(sort, dict) else list(sort.items())

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for path, way in reversed(keys):
            x, y = (a, b) if path is None else (plain_path(Value(a, inner), path.split(".")).col, plain_path(Value(b, inner), path.split(".")).col)
            order = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)
            out = F.when(order == 0, out).otherwise(order * int(way))
        return out

    return F.array_sort(col, compare)


def _add_to_set(path: str, x: object) -> Change:
    items = [x]
    if isinstance(x, dict) and "$each" in x:
        if len(x) > 1:
            raise bad(f"Found unexpected fields after $each in $addToSet: {ejson.format(x, False)}")
        items = x["$each"]
        if not isinstance(items, list):
            raise bad(f"The argument to $each in $addToSet must be an array but it was of type {type_name(items)}")

    def add(v: Value) -> Value:
        old, new, kind = _array_of(v, items, path, "Cannot apply $addToSet to non-array field. Field named '{path}' has non-array type {type}")
        return Value(F.concat(old, F.array_distinct(F.array_except(new, old))), kind)

    return add


# ---- putting changes into rows


def changed(v: Value, parts: list[str], change: Change, path: str) -> Value:
    """A value with a change at a path: documents are made on the way, numbers are positions of arrays."""
    if not parts:
        return change(v)
    if isinstance(v.type, T.ArrayType):
        if not parts[0].isdigit():
            raise bad(f"Cannot create field '{parts[0]}' in element {{{path}: array}}", NOT_VIABLE)
        k = int(parts[0])
        if k > MOST_PAD:
            raise bad(f"can't backfill array to larger than {MOST_PAD} elements")
        inner = v.type.elementType
        probe = changed(Value(F.lit(None).cast(inner), inner), parts[1:], change, path)
        fresh = changed(Value(F.lit(None).cast(inner), inner), parts[1:], change, path).col.cast(probe.type)
        kind = T.ArrayType(probe.type)
        there = F.transform(v.col, lambda e, i: F.when(i == k, changed(Value(e, inner), parts[1:], change, path).col.cast(probe.type)).otherwise(e.cast(probe.type)))
        padded = F.concat(v.col.cast(kind), F.array_repeat(F.lit(None).cast(probe.type), F.greatest(F.lit(k) - F.size(v.col), F.lit(0))), F.array(fresh))
        return Value(F.when(F.size(v.col) > k, there).otherwise(padded), kind)
    if not v.missing and not isinstance(v.type, T.StructType):
        raise bad(f"Cannot create field '{parts[0]}' in element {{{path}: {type_text(v.type)}}}", NOT_VIABLE)
    names = v.type.fieldNames() if isinstance(v.type, T.StructType) else []
    fields = {n: child(v, n) for n in names}
    fields[parts[0]] = changed(fields.get(parts[0], Value(F.lit(None), None)), parts[1:], change, path)
    fields = {n: f if not f.missing else Value(F.lit(None).cast("string"), T.StringType()) for n, f in fields.items()}
    return Value(F.struct(*[f.col.alias(n) for n, f in fields.items()]), T.StructType([T.StructField(n, f.type) for n, f in fields.items()]))


def apply_update(df: DataFrame, spec: object, hit: Column, now: datetime | None = None, inserting: bool = False) -> DataFrame:
    """Rows for which ``hit`` holds, updated; the columns keep their order, new ones follow."""
    replacement, ops = parse_update(spec)
    now = now or datetime.now(timezone.utc)
    root = Root(df.schema)
    fields = {n: child(root, n) for n in root.type.fieldNames()}
    old = dict(fields)
    if replacement is not None:
        for n, v in list(fields.items()):
            if n != ID:
                fields[n] = _as(v, literal(replacement.get(n)))
        for n, x in replacement.items():
            if n not in fields and n != ID:
                fields[n] = _as(Value(F.lit(None), None), literal(x))
        if ID in replacement and not inserting:
            hit = hit & (F.when(equals(replacement[ID])(old[ID]), F.lit(True)).otherwise(F.raise_error(F.lit(f"After applying the update, the (immutable) field '_id' was found to have been altered [{IMMUTABLE}]")).cast("boolean")))
    for op, path, arg in ops:
        parts = path.split(".")
        if op == "$setOnInsert" and not inserting:
            continue
        if parts[0] == ID and not inserting:
            raise bad("Performing an update on the path '_id' would modify the immutable field '_id'", IMMUTABLE)
        if op == "$rename":
            moved = plain_path(fields[parts[0]], parts[1:]) if parts[0] in fields else Value(F.lit(None), None)
            if moved.missing:
                continue
            to = arg.split(".")
            target = fields.get(to[0], Value(F.lit(None), None))
            fields[to[0]] = changed(target, to[1:], lambda v, m=moved: Value(F.coalesce(m.col, v.col.cast(m.type) if not v.missing else F.lit(None).cast(m.type)), m.type), arg)
            fields[parts[0]] = changed(fields[parts[0]], parts[1:], lambda v: Value(F.lit(None).cast(v.type), v.type), path)
            continue
        if op in ("$unset", "$pop", "$pull", "$pullAll") and (parts[0] not in fields or plain_path(fields[parts[0]], [p for p in parts[1:] if not p.isdigit()]).missing and not any(p.isdigit() for p in parts)):
            continue
        fields[parts[0]] = changed(fields.get(parts[0], Value(F.lit(None), None)), parts[1:], change_of(op, path, arg, now), path)
    columns = []
    for n, v in fields.items():
        if n not in old:
            columns.append(F.when(hit, v.col).alias(n))
        elif v is old[n]:
            columns.append(v.col.alias(n))
        else:
            kind = v.type if not v.missing else old[n].type
            columns.append(F.when(hit, v.col.cast(kind)).otherwise(_widened(old[n], kind)).alias(n))
    return df.select(*columns)


def _widened(v: Value, kind: T.DataType) -> Column:
    """An unchanged value in its changed neighbours' type: fields by name, those it hasn't being NULL."""
    if v.type == kind:
        return v.col
    if isinstance(kind, T.StructType) and isinstance(v.type, T.StructType):
        parts = [(_widened(child(v, f.name), f.dataType) if f.name in v.type.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(v.col.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType) and isinstance(v.type, T.ArrayType):
        inner = v.type.elementType
        return F.transform(v.col, lambda e: _widened(Value(e, inner), kind.elementType))
    return v.col.cast(kind)


def update(df: DataFrame, filter: object, spec: object, multi: bool = False, upsert: bool = False, now: datetime | None = None, new_id: object = None) -> DataFrame:
    """The collection with its matching rows updated: all with ``multi``, else the one of least ``_id``.

    ``upsert`` adds a row, made of the filter's equalities and the update, if none matches; its ``_id`` comes from
    either, or is ``new_id``.
    """
    parsed = ejson.parse(filter) or {}
    hit = compile_filter(parsed, start(df).root)
    if multi and parse_update(spec)[0] is not None:
        raise bad("multi update is not supported for replacement-style update", FAILED_TO_PARSE)
    if multi or ID not in df.columns:
        out = apply_update(df, spec, hit, now)
    else:
        out = apply_update(df, spec, _least(df, hit), now)
    if not upsert or not df.where(hit).isEmpty():
        return out
    return out.unionByName(_seed(df, parsed, spec, now, new_id), allowMissingColumns=True)


def _least(df: DataFrame, hit: Column) -> Column:
    """Whether a row is the one of least ``_id`` among those for which ``hit`` holds; that one id is looked up now."""
    value = df.where(hit).agg(F.min(ID)).first()[0]
    return F.lit(False) if value is None else F.coalesce(quoted(ID) == F.lit(value), F.lit(False))


def equalities(filter: dict) -> dict[str, object]:
    """Paths that a filter pins to one value."""
    out: dict[str, object] = {}

    def put(path: str, value: object) -> None:
        if path in out:
            raise bad(f"cannot infer query fields to set, path '{path}' is matched twice", NOT_SINGLE)
        for q in out:
            if q.startswith(path + ".") or path.startswith(q + "."):
                raise bad(f"cannot infer query fields to set, both paths '{q}' and '{path}' are matched", NOT_SINGLE)
        out[path] = value

    for name, arg in filter.items():
        if name == "$and":
            for part in arg:
                for path, value in equalities(part).items():
                    put(path, value)
        elif name.startswith("$"):
            continue
        elif not is_operators(arg):
            if not isinstance(arg, Regex):
                put(name, arg)
        elif "$eq" in arg:
            put(name, arg["$eq"])
        elif "$all" in arg and len(arg["$all"]) == 1:
            put(name, arg["$all"][0])
    return out


def _seed(df: DataFrame, filter: dict, spec: object, now: datetime | None, new_id: object) -> DataFrame:
    spark = df.sparkSession
    replacement, _ = parse_update(spec)
    seeds = equalities(filter)
    if replacement is not None:
        seeds = {k: v for k, v in seeds.items() if k == ID}
        if ID in replacement:
            seeds[ID] = replacement[ID]
    if ID in df.columns and ID not in seeds and not any(p == ID for _, p, _ in parse_update(spec)[1]):
        if new_id is None:
            raise bad("an upsert needs an _id: give new_id")
        seeds[ID] = new_id
    visible = T.StructType([f for f in df.schema.fields if not f.name.startswith("__")])
    row = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in visible.fields])
    if seeds:
        row = apply_update(row, {"$set": seeds}, F.lit(True), now, inserting=True)
    return apply_update(row, spec, F.lit(True), now, inserting=True)


def delete(df: DataFrame, filter: object, multi: bool = True) -> DataFrame:
    """The collection without its matching rows: all, or the one of least ``_id``."""
    hit = compile_filter(ejson.parse(filter) or {}, start(df).root)
    if multi:
        return df.where(~hit)
    return df.where(~_least(df, hit))


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The collection with new rows; an ``_id`` that is null, twice among them or there already raises when it is read."""
    taken = F.raise_error(F.concat(F.lit("E11000 duplicate key error, _id: "), F.coalesce(F.col(ID).cast("string"), F.lit("null"))))
    counts = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("__n")).join(df.select(quoted(ID), F.lit(True).alias("__old")), ID, "left")
    fine = counts.where(F.when((F.col("__n") > 1) | F.col("__old").isNotNull(), taken.cast("boolean")).otherwise(F.lit(True))).select(ID)
    return df.unionByName(rows.join(fine, rows[ID].eqNullSafe(fine[ID]), "left_semi"), allowMissingColumns=True)
