"""An independent evaluator of filters over Python documents, one value at a time."""

from __future__ import annotations

import math
import re


def values_at(doc: object, parts: list[str]) -> list[tuple[bool, object]]:
    """(present, value) at a path: through arrays, a number also being a position."""
    if not parts:
        return [(True, doc)]
    if isinstance(doc, list):
        out = []
        for x in doc:
            if isinstance(x, dict):
                out += values_at(x, parts)
        if parts[0].isdigit() and int(parts[0]) < len(doc):
            out += values_at(doc[int(parts[0])], parts[1:])
        return out
    if isinstance(doc, dict) and parts[0] in doc:
        return values_at(doc[parts[0]], parts[1:])
    return [(False, None)]


def kind(v: object) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else type(v).__name__


def spread(found: list[tuple[bool, object]]) -> list[tuple[bool, object]]:
    return [y for p, v in found for y in ([(p, v)] + ([(True, x) for x in v] if isinstance(v, list) else []))]


def one(op: str, v: object, present: bool, x: object) -> bool:
    if op == "$eq":
        if x is None:
            return not present or v is None
        return present and v is not None and kind(v) == kind(x) and (v == x or (isinstance(x, float) and isinstance(v, float) and math.isnan(x) and math.isnan(v)))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if x is None:
            return op in ("$gte", "$lte") and (not present or v is None)
        if not present or v is None or kind(v) != kind(x):
            return False
        if isinstance(v, float) and math.isnan(v) or isinstance(x, float) and math.isnan(x):
            return op in ("$gte", "$lte") and all(isinstance(y, float) and math.isnan(y) for y in (v, x))
        return {"$gt": v > x, "$gte": v >= x, "$lt": v < x, "$lte": v <= x}[op]
    if op == "$mod":
        return present and kind(v) == "number" and math.isfinite(v) and math.fmod(math.trunc(v), x[0]) == x[1]
    if op == "$regex":
        return present and isinstance(v, str) and re.search(x, v) is not None
    raise NotImplementedError(op)


def field(doc: dict, path: str, cond: object) -> bool:
    found = values_at(doc, path.split("."))
    if not (isinstance(cond, dict) and cond and next(iter(cond)).startswith("$")):
        cond = {"$eq": cond}
    for op, x in cond.items():
        if op == "$ne":
            ok = not any(one("$eq", v, p, x) for p, v in spread(found))
        elif op in ("$in", "$nin"):
            ok = any(one("$eq", v, p, y) for p, v in spread(found) for y in x) == (op == "$in")
        elif op == "$exists":
            ok = any(p and v is not None for p, v in found) == x
        elif op == "$size":
            ok = any(isinstance(v, list) and len(v) == x for _, v in found)
        elif op == "$all":
            ok = bool(x) and all(any(one("$eq", v, p, y) for p, v in spread(found)) for y in x)
        elif op == "$not":
            ok = not field(doc, path, x)
        elif op == "$elemMatch":
            whole = not next(iter(x)).startswith("$")
            ok = any(isinstance(v, list) and any((isinstance(e, dict) and matches(e, x)) if whole else all(one(o, e, True, y) for o, y in x.items()) for e in v) for _, v in found)
        else:
            ok = any(one(op, v, p, x) for p, v in spread(found))
        if not ok:
            return False
    return True


def matches(doc: dict, spec: dict) -> bool:
    for name, arg in spec.items():
        if name == "$and":
            ok = all(matches(doc, s) for s in arg)
        elif name == "$or":
            ok = any(matches(doc, s) for s in arg)
        elif name == "$nor":
            ok = not any(matches(doc, s) for s in arg)
        else:
            ok = field(doc, name, arg)
        if not ok:
            return False
    return True
