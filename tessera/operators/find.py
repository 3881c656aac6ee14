"""Finds, counts, distinct values and aggregations over a collection's frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import bad
from tessera.functions import ejson
from tessera.functions.filters import NEAR, compile_filter
from tessera.functions.values import Value, child
from tessera.operators import near, stages
from tessera.operators.stages import Frame, finish, start
from tessera.plans.stages import Stage, parse_pipeline, path_tree, rewrite, sort_keys


def run_stage(f: Frame, s: Stage) -> Frame:
    if s.kind == "match":
        return stages.match(f, s.spec)
    if s.kind == "project":
        return stages.project(f, s.spec, s.more["id"])
    if s.kind == "addFields":
        return stages.add_fields(f, s.spec)
    if s.kind == "unset":
        return stages.unset(f, s.spec)
    if s.kind == "group":
        return stages.group(f, s.spec, s.more["fields"])
    if s.kind == "sort":
        return stages.sort(f, s.spec)
    if s.kind == "limit":
        return stages.limit(f, s.spec)
    if s.kind == "skip":
        return stages.skip(f, s.spec)
    if s.kind == "unwind":
        return stages.unwind(f, s.spec, s.more["index"], s.more["preserve"])
    if s.kind == "count":
        return stages.count(f, s.spec)
    return near.geo_near(f, s.spec)


def aggregate(df: DataFrame, pipeline: object, wide: bool = False) -> DataFrame:
    """The result of a pipeline over a collection."""
    f = start(df, wide)
    for s in rewrite(parse_pipeline(pipeline)):
        f = run_stage(f, s)
    return finish(f)


# ---- find


def projection_of(f: Frame, spec: object) -> Frame:
    """A find's projection: inclusion or exclusion of paths, ``_id`` kept unless it says otherwise."""
    spec = ejson.parse(spec)
    if not spec:
        return f
    entries: list[tuple[list[str], bool]] = []

    def walk(prefix: str, doc: dict) -> None:
        for name, v in doc.items():
            path = f"{prefix}{name}"
            if any(p == "" for p in path.split(".")):
                raise bad("FieldPath field names may not be empty strings.")
            if path.endswith(".$") or ".$." in path:
                raise bad("positional projection is not supported in v1")
            if isinstance(v, dict):
                if not v:
                    raise bad(f"An empty sub-projection is not a valid value. Found empty object at path {path}")
                op = next(iter(v))
                if op.startswith("$"):
                    raise bad(f"unsupported projection operator '{op}' in v1")
                walk(path + ".", v)
            elif isinstance(v, (bool, int, float)):
                if any(p.startswith("$") for p in path.split(".")):
                    raise bad("FieldPath field names may not start with '$'.")
                entries.append((path.split("."), bool(v)))
            else:
                raise bad(f"unsupported projection value for field '{path}' in v1: computed fields need $project in an aggregation")

    walk("", spec)
    own = dict((tuple(p), v) for p, v in entries).get(("_id",))
    others = [(p, v) for p, v in entries if p != ["_id"]]
    keep = others[0][1] if others else bool(own)
    for p, v in others:
        if v != keep:
            raise bad(f"Cannot do {'inclusion' if v else 'exclusion'} on field {'.'.join(p)} in {'inclusion' if keep else 'exclusion'} projection")
    try:
        tree = path_tree([(p, True) for p, _ in (others if keep else [e for e in entries if not e[1]])], "projection")
    except ValueError as e:
        raise bad(str(e).partition(":: caused by :: ")[2] or str(e)) from e
    if keep:
        return stages.project(f, tree, True if own is None else own)
    return stages.unset(f, tree)


def split_near(spec: dict) -> tuple[dict, str | None, str | None, object]:
    """A filter without its top-level near condition, and that condition's field, operator and argument."""
    rest, found = {}, []
    for name, arg in spec.items():
        if isinstance(arg, dict) and any(op in arg for op in NEAR):
            op = next(o for o in NEAR if o in arg)
            bounds = {k: arg[k] for k in ("$maxDistance", "$minDistance") if k in arg}
            found.append((name, op, arg[op], bounds))
            left = {k: v for k, v in arg.items() if k != op and k not in bounds}
            if left:
                rest[name] = left
        else:
            rest[name] = arg
    if len(found) > 1:
        raise bad("Too many geoNear expressions")
    if not found:
        return rest, None, None, None
    name, op, arg, bounds = found[0]
    return rest, name, op, (arg, bounds)


def find(df: DataFrame, filter: object = None, sort: object = None, skip: int = 0, limit: int = 0, projection: object = None) -> DataFrame:
    """Rows that meet a filter, sorted, skipped, limited and projected, in that order. Without a sort rows come in no order, save
    that skip and limit count them by ``_id``.

    A near condition in the filter orders rows by distance and can't go with a sort.
    """
    spec = ejson.parse(filter) or {}
    rest, field, op, arg = split_near(spec)
    f = stages.match(start(df), rest)
    if field is not None:
        if sort:
            raise bad("$near and $nearSphere cannot be used with a sort")
        f = near.by_distance(f, field, op, *arg)
    if sort:
        f = stages.sort(f, sort_keys(ejson.parse(sort)))
    if skip < 0 or limit < 0:
        raise bad("the number to skip cannot be negative" if skip < 0 else "the limit must be positive")
    if skip:
        f = stages.skip(f, skip)
    if limit:
        f = stages.limit(f, limit)
    if projection:
        f = projection_of(f, projection)
    return finish(f.but(sorted=True) if sort or skip or limit or field is not None else f)


def find_one(df: DataFrame, filter: object = None, sort: object = None, projection: object = None) -> DataFrame:
    return find(df, filter, sort, 0, 1, projection)


def count(df: DataFrame, filter: object = None) -> DataFrame:
    """One row: ``n``. Without a filter file footers answer."""
    f = start(df)
    spec = ejson.parse(filter)
    return (stages.match(f, spec) if spec else f).df.agg(F.count(F.lit(1)).alias("n"))


def distinct(df: DataFrame, path: str, filter: object = None) -> DataFrame:
    """``value``: the distinct values at a path, arrays giving their elements, in order; null and missing give none."""
    f = start(df)
    spec = ejson.parse(filter)
    f = stages.match(f, spec) if spec else f
    v = _leaves(f.root, path.split("."))
    if v.missing:
        return f.df.limit(0).select(F.lit(None).cast("string").alias("value"))
    col: Column = v.col
    out = f.df.select((F.explode(col) if isinstance(v.type, T.ArrayType) else col).alias("value"))
    out = out.where("value is not null").distinct()
    kind = v.type.elementType if isinstance(v.type, T.ArrayType) else v.type
    return out.orderBy(*stages.sort_columns(Value(F.col("value"), kind), True))


def _leaves(v: Value, parts: list[str]) -> Value:
    """All values at a path, through arrays and positions, as one array where an array lies on the way."""
    for i, p in enumerate(parts):
        if isinstance(v.type, T.ArrayType):
            inner = v.type.elementType
            if p.isdigit():
                return _leaves(Value(F.get(v.col, F.lit(int(p))), inner), parts[i + 1 :])
            if not isinstance(inner, T.StructType):
                return Value(F.lit(None), None)
            probe = _leaves(Value(F.lit(None), inner), parts[i:])
            if probe.missing:
                return probe
            out = F.transform(v.col, lambda x: _leaves(Value(x, inner), parts[i:]).col)
            nested = isinstance(probe.type, T.ArrayType)
            return Value(F.flatten(F.filter(out, lambda x: x.isNotNull())) if nested else out, probe.type if nested else T.ArrayType(probe.type))
        v = child(v, p)
    return v


def matching(df: DataFrame, filter: object) -> Column:
    """A filter's condition over a frame's columns."""
    return compile_filter(ejson.parse(filter) or {}, start(df).root)
