"""Pipeline stages: parsed from their documents, with every mistake that needs no data found here."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.errors import bad
from tessera.functions import ejson
from tessera.functions.ejson import type_name

# Limits, stage names and accumulators.
MOST_STAGES, MOST_SORT_KEYS = 1_000, 32
ACCUMULATORS = ("$sum", "$avg", "$min", "$max", "$count", "$first", "$last", "$push", "$addToSet")
REFUSED_ACCUMULATORS = ("$stdDevPop", "$stdDevSamp", "$mergeObjects", "$top", "$topN", "$bottom", "$bottomN", "$firstN", "$lastN", "$maxN", "$minN", "$median", "$percentile", "$accumulator", "$concatArrays", "$setUnion")


@dataclass
class Stage:
    """``kind``: the stage's name without its sign; ``spec``: its checked argument."""

    kind: str
    spec: object
    more: dict = field(default_factory=dict)


def parse_pipeline(pipeline: object) -> list[Stage]:
    """Stages of a pipeline, given as Extended JSON text or as values."""
    steps = ejson.parse(pipeline)
    if not isinstance(steps, list):
        raise bad("malformed pipeline")
    if len(steps) > MOST_STAGES:
        raise bad(f"Pipeline length must be no longer than {MOST_STAGES} stages", 7749501)
    out = []
    for i, step in enumerate(steps):
        if not isinstance(step, dict):
            raise bad("Each element of the 'pipeline' array must be an object", 14)
        if len(step) != 1:
            raise bad("A pipeline stage specification object must contain exactly one field.", 40323)
        name, arg = next(iter(step.items()))
        if name not in PARSERS:
            raise bad(f"unsupported pipeline stage '{name}' in v1", 40324)
        if name == "$geoNear" and i:
            raise bad("$geoNear is only valid as the first stage in a pipeline.", 40602)
        out.append(PARSERS[name](arg))
    return out


def _match(arg: object) -> Stage:
    if not isinstance(arg, dict):
        raise bad("the match filter must be an expression in an object", 15959)
    return Stage("match", arg)


def sort_keys(arg: object) -> list[tuple[str, bool]]:
    """(path, ascending) pairs."""
    if not isinstance(arg, dict):
        raise bad("the $sort key specification must be an object", 15973)
    if not arg:
        raise bad("$sort stage must have at least one sort key", 15976)
    if len(arg) > MOST_SORT_KEYS:
        raise bad(f"cannot sort with more than {MOST_SORT_KEYS} keys")
    out = []
    for path, way in arg.items():
        if not path:
            raise bad("FieldPath cannot be constructed with empty string")
        if "" in path.split("."):
            raise bad("FieldPath field names may not be empty strings.")
        if any(p.startswith("$") for p in path.split(".")):
            raise bad("FieldPath field names may not start with '$'.")
        if isinstance(way, dict):
            raise bad("unsupported sort value {$meta: ...} in v1")
        if isinstance(way, bool) or not isinstance(way, (int, float)) or way not in (1, -1):
            raise bad("$sort key ordering must be 1 (for ascending) or -1 (for descending)")
        out.append((path, way == 1))
    return out


def _count_of(arg: object, what: str) -> int:
    code, sign = (15957, 15958) if what == "limit" else (15972, 15956)
    if isinstance(arg, bool) or not isinstance(arg, (int, float)) or arg != int(arg):
        raise bad(f"the {what} must be specified as a number", code)
    if what == "limit" and arg <= 0:
        raise bad("the limit must be positive", sign)
    if what == "skip" and arg < 0:
        raise bad("the number to skip cannot be negative", sign)
    return int(arg)


def check_path(path: str, stage: str) -> list[str]:
    if not path:
        raise bad(f"Invalid {stage} :: caused by :: FieldPath cannot be constructed with empty string", 40352)
    parts = path.split(".")
    if "" in parts:
        raise bad(f"Invalid {stage} :: caused by :: FieldPath field names may not be empty strings.", 15998)
    if any(p.startswith("$") for p in parts):
        raise bad(f"Invalid {stage} :: caused by :: FieldPath field names may not start with '$'.", 16410)
    return parts


def path_tree(entries: list[tuple[list[str], object]], stage: str) -> dict:
    """A tree of paths; leaves are ``("leaf", value)``. One path may not lie on another."""
    tree: dict = {}
    for parts, value in entries:
        at = tree
        for i, p in enumerate(parts[:-1]):
            at = at.setdefault(p, {})
            if isinstance(at, tuple):
                raise bad(f"Invalid {stage} :: caused by :: Path collision at {'.'.join(parts[: i + 1])}", 31250)
        if parts[-1] in at:
            raise bad(f"Invalid {stage} :: caused by :: Path collision at {'.'.join(parts)}", 31250)
        at[parts[-1]] = ("leaf", value)
    return tree


def flatten(spec: dict, stage: str, prefix: tuple[str, ...] = ()) -> list[tuple[list[str], object]]:
    """Dotted paths and sub-documents as one list of paths; operator documents are values."""
    out = []
    for name, value in spec.items():
        parts = [*prefix, *check_path(name, stage)]
        if isinstance(value, dict) and not any(k.startswith("$") for k in value):
            if not value:
                if stage == "$project":
                    raise bad(f"Invalid $project :: caused by :: An empty sub-projection is not a valid value. Found empty object at path {'.'.join(parts)}", 51270)
                out.append((parts, {"$literal": {}}))
                continue
            out += flatten(value, stage, tuple(parts))
        else:
            out.append((parts, value))
    return out


def _add_fields(arg: object) -> Stage:
    if not isinstance(arg, dict):
        raise bad(f"$addFields specification stage must be an object, got {type_name(arg)}", 40272)
    return Stage("addFields", path_tree(flatten(arg, "$addFields"), "$addFields"))


def _unset(arg: object) -> Stage:
    paths = [arg] if isinstance(arg, str) else arg
    if not isinstance(paths, list):
        raise bad("$unset specification must be a string or an array", 31002)
    if not paths:
        raise bad("$unset specification must be a string or an array with at least one field", 31119)
    if not all(isinstance(p, str) for p in paths):
        raise bad("$unset specification must be a string or an array containing only string values", 31120)
    return Stage("unset", path_tree([(check_path(p, "$unset"), 0) for p in paths], "$unset"))


def is_flag(value: object) -> bool:
    return isinstance(value, (bool, int, float))


def _project(arg: object) -> Stage:
    if not isinstance(arg, dict):
        raise bad("$project specification must be an object", 15969)
    if not arg:
        raise bad("Invalid $project :: caused by :: projection specification must have at least one field", 51272)
    entries = flatten(arg, "$project")
    tree = path_tree(entries, "$project")
    others = [(p, v) for p, v in entries if p != ["_id"]]
    out = [".".join(p) for p, v in others if is_flag(v) and not v]
    kept = [".".join(p) for p, v in others if not (is_flag(v) and not v)]
    if out and kept:
        raise bad(f"Invalid $project :: caused by :: Cannot do exclusion on field {out[0]} in inclusion projection", 31254)
    own = dict((tuple(p), v) for p, v in entries).get(("_id",), True)
    if (out or not kept) and is_flag(own) and not (own and not out):
        return Stage("unset", path_tree([(p, 0) for p, v in entries if is_flag(v) and not v], "$project"))
    return Stage("project", tree, {"id": own})


def _group(arg: object) -> Stage:
    if not isinstance(arg, dict):
        raise bad("a group's fields must be specified in an object", 15947)
    if "_id" not in arg:
        raise bad("a group specification must include an _id", 15955)
    fields: dict[str, tuple[str, object]] = {}
    for name, acc in arg.items():
        if name == "_id":
            continue
        if "." in name:
            raise bad(f"The field name '{name}' cannot contain '.'", 40235)
        if name.startswith("$"):
            raise bad(f"The field name '{name}' cannot be an operator name", 40236)
        if not isinstance(acc, dict):
            raise bad(f"The field '{name}' must be an accumulator object", 40234)
        if len(acc) != 1:
            raise bad(f"The field '{name}' must specify one accumulator", 40238)
        op, x = next(iter(acc.items()))
        if op in REFUSED_ACCUMULATORS:
            raise bad(f"unsupported accumulator '{op}' in v1", 15952)
        if op not in ACCUMULATORS:
            raise bad(f"unknown group operator '{op}'", 15952)
        if op == "$count" and x != {}:
            raise bad("$count takes no arguments, i.e. $count:{}")
        if op != "$count" and isinstance(x, list):
            raise bad(f"The {op} accumulator is a unary operator", 40237)
        fields[name] = (op, x)
    return Stage("group", arg["_id"], {"fields": fields})


def _unwind(arg: object) -> Stage:
    more = {"index": None, "preserve": False}
    path = arg
    if isinstance(arg, dict):
        path = None
        for name, v in arg.items():
            if name == "path":
                if not isinstance(v, str):
                    raise bad(f"expected a string as the path for $unwind stage, got {type_name(v)}", 28808)
                path = v
            elif name == "includeArrayIndex":
                if not isinstance(v, str) or not v:
                    raise bad(f"expected a non-empty string for the includeArrayIndex option to $unwind stage, got {type_name(v)}", 28810)
                if v.startswith("$"):
                    raise bad(f"includeArrayIndex option to $unwind stage should not be prefixed with a '$': {v}", 28822)
                more["index"] = v
            elif name == "preserveNullAndEmptyArrays":
                if not isinstance(v, bool):
                    raise bad(f"expected a boolean for the preserveNullAndEmptyArrays option to $unwind stage, got {type_name(v)}", 28809)
                more["preserve"] = v
            else:
                raise bad(f"unrecognized option to $unwind stage: {name}", 28811)
        if path is None:
            raise bad("no path specified to $unwind stage", 28812)
    elif not isinstance(arg, str):
        raise bad(f"expected either a string or an object as specification for $unwind stage, got {type_name(arg)}", 15981)
    if not path.startswith("$"):
        raise bad(f"path option to $unwind stage should be prefixed with a '$': {path}", 28818)
    return Stage("unwind", check_path(path[1:], "$unwind"), more)


def _count(arg: object) -> Stage:
    if not isinstance(arg, str):
        raise bad("the count field must be a non-empty string", 40156)
    if not arg:
        raise bad("the count field must be a non-empty string", 40157)
    if arg.startswith("$"):
        raise bad("the count field cannot be a $-prefixed path", 40158)
    if "." in arg:
        raise bad("the count field cannot contain '.'", 40160)
    return Stage("count", arg)


def _geo_near(arg: object) -> Stage:
    if not isinstance(arg, dict):
        raise bad("$geoNear requires an object argument")
    known = ("near", "distanceField", "spherical", "query", "minDistance", "maxDistance", "distanceMultiplier", "includeLocs", "key")
    for name in arg:
        if name in ("limit", "num"):
            raise bad(f"$geoNear no longer supports the '{name}' parameter; use a $limit stage")
        if name not in known:
            raise bad(f"unknown argument to $geoNear: {name}")
    if "near" not in arg:
        raise bad("$geoNear requires a 'near' option")
    if not isinstance(arg.get("query", {}), dict):
        raise bad("query must be an object")
    if not isinstance(arg.get("includeLocs", ""), str):
        raise bad("includeLocs must be a field name")
    if "key" in arg and (not isinstance(arg["key"], str) or not arg["key"]):
        raise bad("$geoNear parameter 'key' must be a non-empty string")
    m = arg.get("distanceMultiplier", 1)
    if isinstance(m, bool) or not isinstance(m, (int, float)) or m < 0:
        raise bad("distanceMultiplier must be a non-negative number")
    if not isinstance(arg["near"], dict) and not arg.get("spherical", False):
        raise bad("$geoNear with legacy coordinates needs spherical: true (v1 has no 2d index)")
    return Stage("geoNear", arg)


PARSERS = {
    "$match": _match,
    "$project": _project,
    "$addFields": _add_fields,
    "$set": _add_fields,
    "$unset": _unset,
    "$group": _group,
    "$sort": lambda arg: Stage("sort", sort_keys(arg)),
    "$limit": lambda arg: Stage("limit", _count_of(arg, "limit")),
    "$skip": lambda arg: Stage("skip", _count_of(arg, "skip")),
    "$unwind": _unwind,
    "$count": _count,
    "$geoNear": _geo_near,
}


def rewrite(stages: list[Stage]) -> list[Stage]:
    """Rewrites that the optimizer of the engine below can't be trusted to do: adjacent skips add up, adjacent
    limits take the least, adjacent matches become one, and a skip before a limit goes with it as one step. Pushing
    filters below sorts and projections is left to the engine below."""
    out: list[Stage] = []
    for s in stages:
        last = out[-1] if out else None
        if last and s.kind == last.kind == "match":
            out[-1] = Stage("match", {"$and": [last.spec, s.spec]} if last.spec and s.spec else last.spec or s.spec)
        elif last and s.kind == last.kind == "limit":
            out[-1] = Stage("limit", min(last.spec, s.spec))
        elif last and s.kind == last.kind == "skip":
            out[-1] = Stage("skip", last.spec + s.spec)
        else:
            out.append(s)
    return out
