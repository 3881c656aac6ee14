"""Pipeline stages as transforms of a frame: a DataFrame with the order that its rows are taken to have.

Order is only tracked: hidden columns hold its keys, and they are sorted by when a stage or the result needs order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import bad
from tessera.functions.expressions import Removed, compile_expr
from tessera.functions.filters import where_filter
from tessera.functions.values import INTEGERS, Root, Value, child, class_of, is_float, plain_path
from tessera.plans.stages import is_flag

ID = "_id"


@dataclass
class Frame:
    """``order``: hidden columns and whether they ascend, the first being the most significant; ``sorted``: whether
    the result must come in that order; ``wide``: integer arithmetic past 64 bits goes on in doubles."""

    df: DataFrame
    order: list[tuple[str, bool]] = field(default_factory=list)
    sorted: bool = False
    wide: bool = False
    hidden: int = 0

    @property
    def root(self) -> Root:
        return Root(self.df.schema)

    @property
    def names(self) -> list[str]:
        return [n for n in self.df.columns if not n.startswith("__")]

    @property
    def secret(self) -> list[str]:
        return [n for n in self.df.columns if n.startswith("__")]

    def but(self, **changes: object) -> "Frame":
        return Frame(**({"df": self.df, "order": self.order, "sorted": self.sorted, "wide": self.wide, "hidden": self.hidden} | changes))

    def by(self) -> list[Column]:
        return [F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, up in self.order]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def start(df: DataFrame, wide: bool = False) -> Frame:
    """Rows of a collection, in order of ``_id`` where there is one."""
    if ID not in df.columns:
        return Frame(df, wide=wide)
    return Frame(df.withColumn("__o0", quoted(ID)), [("__o0", True)], wide=wide, hidden=1)


def finish(f: Frame) -> DataFrame:
    df = f.df.orderBy(*f.by()) if f.sorted and f.order else f.df
    return df.select(*[quoted(n) for n in f.names])


def select(f: Frame, columns: dict[str, Column]) -> Frame:
    """The frame with these visible columns."""
    return f.but(df=f.df.select(*[c.alias(n) for n, c in columns.items()], *[quoted(n) for n in f.secret]))


def match(f: Frame, spec: dict) -> Frame:
    return f.but(df=f.df.where(where_filter(spec, f.root)))


# ---- sort, limit, skip


def sort_columns(v: Value, up: bool) -> list[Column]:
    """Sort keys of one path: arrays by their least or largest element, an empty array below null, NaN below numbers."""
    if v.missing:
        return []
    c, kind = v.col, v.type
    keys = []
    if isinstance(kind, T.ArrayType):
        keys.append(F.when(F.size(c) == 0, 0).otherwise(1))
        c, kind = (F.array_min(c) if up else F.array_max(c)), kind.elementType
    if is_float(kind):
        keys.append(F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2))
    return [*keys, c]


def matched_path(v: Value, parts: list[str]) -> Value:
    """A path for sorting: through arrays, the values of all elements as one array."""
    for i, p in enumerate(parts):
        if isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, T.StructType):
            inner = v.type.elementType
            probe = matched_path(Value(F.lit(None), inner), parts[i:])
            if probe.missing:
                return probe
            out = F.transform(v.col, lambda x: matched_path(Value(x, inner), parts[i:]).col)
            nested = isinstance(probe.type, T.ArrayType)
            return Value(F.flatten(out) if nested else out, probe.type if nested else T.ArrayType(probe.type))
        v = child(v, p)
    return v


def sort(f: Frame, keys: list[tuple[str, bool]]) -> Frame:
    df, order, n = f.df, [], f.hidden
    for path, up in keys:
        for c in sort_columns(matched_path(f.root, path.split(".")), up):
            name = f"__o{n}"
            df, n = df.withColumn(name, c), n + 1
            order.append((name, up))
    return f.but(df=df, order=order + f.order, sorted=True, hidden=n)


def limit(f: Frame, n: int) -> Frame:
    return f.but(df=(f.df.orderBy(*f.by()) if f.order else f.df).limit(n))


def skip(f: Frame, n: int) -> Frame:
    return f.but(df=(f.df.orderBy(*f.by()) if f.order else f.df).offset(n))


def count(f: Frame, name: str) -> Frame:
    """One row with the number of rows, none if there are none."""
    return Frame(f.df.agg(F.count(F.lit(1)).alias(name)).where(quoted(name) > 0), wide=f.wide)


# ---- unwind


def unwind(f: Frame, path: list[str], index: str | None, preserve: bool) -> Frame:
    """A row for each element. A scalar passes as it is; no value, and an empty array, pass only with ``preserve``."""
    v = plain_path(f.root, path)
    null = F.lit(None).cast("bigint")
    if v.missing:
        out = f.but(df=f.df if preserve else f.df.where(F.lit(False)))
        return assign(out, index.split("."), Value(null, T.LongType())) if index else out
    if not isinstance(v.type, T.ArrayType):
        out = f if preserve else f.but(df=f.df.where(v.col.isNotNull()))
        return assign(out, index.split("."), Value(null, T.LongType())) if index else out
    at, value = f"__o{f.hidden}", "__value"
    explode = F.posexplode_outer if preserve else F.posexplode
    df = f.df.select("*", explode(v.col).alias(at, value))
    out = f.but(df=df, order=[*f.order, (at, True)], hidden=f.hidden + 1)
    out = assign(out, path, Value(F.col(value), v.type.elementType))
    out = out.but(df=out.df.drop(value))
    return assign(out, index.split("."), Value(F.col(at).cast("bigint"), T.LongType())) if index else out


def assign(f: Frame, path: list[str], value: Value) -> Frame:
    tree: dict = ("leaf", value)
    for p in reversed(path):
        tree = {p: tree}
    return _set(f, tree)


# ---- fields


def put(v: Value | None, tree: dict) -> Value:
    """A document with a tree of fields put in: replaced in place, else appended; arrays map; scalars give way."""
    if v is not None and isinstance(v.type, T.ArrayType):
        inner = v.type.elementType
        probe = put(Value(F.lit(None), inner), tree)
        return Value(F.transform(v.col, lambda x: put(Value(x, inner), tree).col), T.ArrayType(probe.type))
    fields: dict[str, Value] = {}
    if v is not None and isinstance(v.type, T.StructType):
        fields = {n: child(v, n) for n in v.type.fieldNames()}
    for name, sub in tree.items():
        new = sub[1] if isinstance(sub, tuple) else put(fields.get(name), sub)
        if isinstance(new, Removed):
            fields.pop(name, None)
        else:
            fields[name] = new
    return _document(fields)


def _document(fields: dict[str, Value]) -> Value:
    kinds = {n: T.StringType() if v.missing or isinstance(v.type, T.NullType) else v.type for n, v in fields.items()}
    cols = [(v.col.cast(kinds[n]) if kinds[n] != v.type else v.col).alias(n) for n, v in fields.items()]
    return Value(F.struct(*cols) if cols else F.lit(None), T.StructType([T.StructField(n, k) for n, k in kinds.items()]) if cols else T.NullType())


def _set(f: Frame, tree: dict) -> Frame:
    root = f.root
    columns = {n: root.field(n) for n in f.names}
    for name, sub in tree.items():
        old = child(root, name)
        new = sub[1] if isinstance(sub, tuple) else put(None if old.missing else old, sub)
        if isinstance(new, Removed):
            columns.pop(name, None)
        else:
            columns[name] = new.col.cast("string") if new.missing or isinstance(new.type, T.NullType) else new.col
    return select(f, columns)


def _compiled(tree: dict, f: Frame) -> dict:
    """A tree whose leaves are values instead of expressions."""
    return {n: ("leaf", compile_expr(s[1], f.root, f.wide)) if isinstance(s, tuple) else _compiled(s, f) for n, s in tree.items()}


def add_fields(f: Frame, tree: dict) -> Frame:
    return _set(f, _compiled(tree, f))


def dropped(v: Value, tree: dict) -> Value:
    """A document without the paths of a tree; arrays map, other values stay."""
    if isinstance(v.type, T.ArrayType):
        inner = v.type.elementType
        probe = dropped(Value(F.lit(None), inner), tree)
        return Value(F.transform(v.col, lambda x: dropped(Value(x, inner), tree).col), T.ArrayType(probe.type))
    if not isinstance(v.type, T.StructType):
        return v
    fields = {}
    for n in v.type.fieldNames():
        if n not in tree:
            fields[n] = child(v, n)
        elif not isinstance(tree[n], tuple):
            fields[n] = dropped(child(v, n), tree[n])
    out = _document(fields)
    return Value(F.when(v.col.isNotNull(), out.col), out.type)


def unset(f: Frame, tree: dict) -> Frame:
    root = f.root
    columns = {}
    for n in f.names:
        if n not in tree:
            columns[n] = root.field(n)
        elif not isinstance(tree[n], tuple):
            columns[n] = dropped(child(root, n), tree[n]).col
    return select(f, columns)


def kept(v: Value, tree: dict) -> Value | None:
    """A document with only a tree's paths: kept fields in their order, then computed ones. Arrays keep their documents."""
    if isinstance(v.type, T.ArrayType):
        inner = v.type.elementType
        if not isinstance(inner, (T.StructType, T.ArrayType)):
            return Value(F.when(v.col.isNotNull(), F.array().cast(v.type)), v.type)
        probe = kept(Value(F.lit(None), inner), tree)
        return None if probe is None else Value(F.transform(v.col, lambda x: kept(Value(x, inner), tree).col), T.ArrayType(probe.type))
    fields: dict[str, Value] = {}
    there = v.type.fieldNames() if isinstance(v.type, T.StructType) else []
    for n in there:
        if n in tree:
            sub = tree[n]
            if not isinstance(sub, tuple):
                part = kept(child(v, n), sub)
                if part is not None:
                    fields[n] = part
            elif sub[1] is True:
                fields[n] = child(v, n)
    fresh = False
    for n, sub in tree.items():
        if isinstance(sub, tuple) and isinstance(sub[1], Value) and not isinstance(sub[1], Removed):
            fields[n], fresh = sub[1], True
        elif not isinstance(sub, tuple) and n not in there and (part := kept(Value(F.lit(None), None), sub)) is not None:
            fields[n], fresh = part, True
    if not fields:
        return None
    out = _document(fields)
    return out if fresh or v.missing else Value(F.when(v.col.isNotNull(), out.col), out.type)


def project(f: Frame, tree: dict, own: object) -> Frame:
    """Only the tree's fields, ``_id`` first unless ``own`` is false."""

    def leaves(t: dict) -> dict:
        return {n: ("leaf", True if is_flag(s[1]) and s[1] else compile_expr(s[1], f.root, f.wide)) if isinstance(s, tuple) else leaves(s) for n, s in t.items()}

    root = f.root
    tree = leaves({n: s for n, s in tree.items() if n != ID})
    columns: dict[str, Column] = {}
    if ID in f.names or not is_flag(own):
        if not is_flag(own):
            columns[ID] = compile_expr(own, root, f.wide).col
        elif own:
            columns[ID] = root.field(ID)
    for n in f.names:
        if n in tree and n != ID:
            sub = tree[n]
            if not isinstance(sub, tuple):
                part = kept(child(root, n), sub)
                if part is not None:
                    columns[n] = part.col
            elif sub[1] is True:
                columns[n] = root.field(n)
    for n, sub in tree.items():
        if isinstance(sub, tuple) and isinstance(sub[1], Value) and not isinstance(sub[1], Removed):
            columns.pop(n, None)
            v = sub[1]
            columns[n] = v.col.cast("string") if v.missing or isinstance(v.type, T.NullType) else v.col
        elif not isinstance(sub, tuple) and n not in f.names and (part := kept(Value(F.lit(None), None), sub)) is not None:
            columns[n] = part.col
    return select(f, columns)


# ---- group


def group(f: Frame, key: object, fields: dict[str, tuple[str, object]]) -> Frame:
    """One row a key, a missing key being null; no rows of no rows, even for a constant key."""
    k = compile_expr(key, f.root, f.wide)
    by = k.col.cast("string") if k.missing or isinstance(k.type, T.NullType) else k.col
    values = {name: compile_expr(x, f.root, f.wide) if op != "$count" else None for name, (op, x) in fields.items()}
    sets = {name: values[name] for name, (op, _) in fields.items() if op == "$addToSet" and f.order and all(up for _, up in f.order) and not values[name].missing and class_of(values[name].type) != "null"}
    aggregates = [_accumulate(f, op, values[name]).alias(name) for name, (op, x) in fields.items() if name not in sets]
    # a constant is no grouping column to the engine below, so it is made one
    keyed = f.df.withColumn("__key", by)
    df = keyed.groupBy("__key").agg(*(aggregates or [F.count(F.lit(1)).alias("__n")]))
    for name, x in sets.items():
        df = df.join(_distinct_values(f, keyed, x.col).select(F.col("__key").alias("__k"), F.col("__set").alias(name)), F.col("__key").eqNullSafe(F.col("__k")), "left").drop("__k").withColumn(name, F.coalesce(quoted(name), F.array().cast(T.ArrayType(x.type))))
    df = df.withColumnRenamed("__key", ID)
    df = df.select(ID, *[quoted(n) for n in fields]).withColumn("__o0", quoted(ID))
    return Frame(df, [("__o0", True)], wide=f.wide, hidden=1)


def _distinct_values(f: Frame, keyed: DataFrame, col: Column) -> DataFrame:
    """``__key``, ``__set``: a group's distinct values, in the order of their first rows; repetitions go before values
    are gathered, so a group of many rows and few values is small."""
    once = keyed.select("__key", col.alias("__v"), F.struct(*[F.col(n) for n, _ in f.order]).alias("__at")).where("__v is not null")
    once = once.groupBy("__key", "__v").agg(F.min("__at").alias("__at"))
    return once.groupBy("__key").agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"]).alias("__set"))


def _accumulate(f: Frame, op: str, v: Value | None) -> Column:
    if op == "$count":
        return F.count(F.lit(1))
    kind = class_of(v.type)
    if op == "$sum":
        if kind != "number":
            return F.max(F.lit(0)).cast("bigint")
        if isinstance(v.type, INTEGERS):
            c = v.col.cast("bigint")
            return F.coalesce(F.try_sum(c).cast("double"), F.sum(c.cast("double")), F.lit(0.0)) if f.wide else F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
        return F.coalesce(F.sum(v.col.cast("double")), F.lit(0.0))
    if op == "$avg":
        return F.avg(v.col.cast("double")) if kind == "number" else F.max(F.lit(None).cast("double"))
    if op in ("$min", "$max"):
        if v.missing or kind == "null":
            return F.max(F.lit(None).cast("string"))
        if not is_float(v.type):
            return F.min(v.col) if op == "$min" else F.max(v.col)
        some, nan = F.when(~F.isnan(v.col), v.col), F.lit(float("nan"))
        if op == "$min":
            return F.when(F.bool_or(F.isnan(v.col)), nan).otherwise(F.min(some))
        return F.coalesce(F.max(some), F.max(v.col))
    col = v.col.cast("string") if v.missing or kind == "null" else v.col
    if op in ("$first", "$last"):
        return _edge(f, col, op == "$first")
    listed = F.transform(_in_order(f, col), lambda x: x["v"])
    if op == "$push":
        return listed
    if op == "$addToSet":
        return F.array_distinct(listed)
    raise bad(f"unknown group operator '{op}'", 15952)


def _edge(f: Frame, col: Column, first: bool) -> Column:
    """The value of the first or last row in the frame's order, null if that has none."""
    if not f.order:
        return F.first(col) if first else F.last(col)
    ways = {up for _, up in f.order}
    if len(ways) == 1:
        by = F.struct(*[F.col(n) for n, _ in f.order])
        return F.min_by(col, by) if first == ways.pop() else F.max_by(col, by)
    keys = [_turned(f, n, up) for n, up in f.order]
    if all(k is not None for k in keys):
        by = F.struct(*keys)
        return F.min_by(col, by) if first else F.max_by(col, by)
    whole = _in_order(f, col, keep=True)
    return F.element_at(whole, 1 if first else -1)["v"]


def _turned(f: Frame, name: str, up: bool) -> Column | None:
    """A key that ascends where ``name`` should descend, nulls last then as they are first now; None for texts and nested values."""
    c, kind = F.col(name), f.df.schema[name].dataType
    if up:
        return F.struct(c.isNotNull(), c)
    c_ = class_of(kind)
    if c_ == "number":
        return F.struct(c.isNull(), -c.cast("decimal(38,0)") if isinstance(kind, INTEGERS) else -c)
    if c_ == "date":
        return F.struct(c.isNull(), -F.unix_micros(c.cast("timestamp")))
    return F.struct(c.isNull(), ~c) if c_ == "bool" else None


def _in_order(f: Frame, col: Column, keep: bool = False) -> Column:
    """The rows' values in the frame's order, as structs with ``v``; those without a value only with ``keep``."""
    value = F.struct(*[F.col(n).alias(n) for n, _ in f.order], col.alias("v"))
    rows = F.collect_list(value if keep else F.when(col.isNotNull(), value))
    if all(up for _, up in f.order):
        return F.sort_array(rows) if f.order else rows

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for n, up in reversed(f.order):
            lower = F.when(a[n].isNull() & b[n].isNull(), 0).when(a[n].isNull(), -1).when(b[n].isNull(), 1).when(a[n] < b[n], -1).when(a[n] > b[n], 1).otherwise(0)
            out = F.when(lower == 0, out).otherwise(lower if up else -lower)
        return out

    return F.array_sort(rows, compare)
