"""Nearest documents: a distance column and one top-k pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import bad
from tessera.functions.expressions import compile_expr
from tessera.functions.sphere import DOCUMENT_RADIUS, haversine, near_box, point_of
from tessera.functions.values import Value, plain_path
from tessera.operators import stages
from tessera.operators.stages import Frame, assign


def point_spec(x: object) -> tuple[float, float, bool]:
    """Longitude, latitude, and whether distances are metres (GeoJSON) rather than radians (legacy)."""
    pair, metres = x, False
    if isinstance(x, dict):
        if "coordinates" in x or "type" in x:
            if x.get("type") != "Point":
                raise bad("$near needs a point")
            pair, metres = x.get("coordinates"), True
        else:
            pair = list(x.values())
    if not isinstance(pair, list) or len(pair) < 2 or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in pair[:2]):
        raise bad("Point must be an array or object")
    lon, lat = float(pair[0]), float(pair[1])
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise bad(f"longitude/latitude is out of bounds, lng: {lon} lat: {lat}")
    return lon, lat, metres


def _bound(v: object, name: str) -> float | None:
    if v is None:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0:
        raise bad(f"{name} must be a non-negative number")
    return float(v)


def distance_to(v: Value, lon: float, lat: float) -> Column:
    """The angle from a document's point, null if it has none."""
    x, y = point_of(v)
    return haversine(F.lit(lon), F.lit(lat), x, y)


def _within(f: Frame, field: str, lon: float, lat: float, scale: float, least: float | None, most: float | None) -> tuple[Frame, str]:
    """Rows with a point whose distance, the angle times ``scale``, lies within bounds; and the distance's column."""
    v = plain_path(f.root, field.split("."))
    x, y = point_of(v)
    name = f"__o{f.hidden}"
    df = f.df
    if most is not None:
        df = df.where(near_box(x, y, (lon, lat), most / scale))
    df = df.withColumn(name, distance_to(v, lon, lat) * scale).where(F.col(name).isNotNull())
    if least is not None:
        df = df.where(F.col(name) >= least)
    if most is not None:
        df = df.where(F.col(name) <= most)
    return f.but(df=df, order=[(name, True), *f.order], sorted=True, hidden=f.hidden + 1), name


def by_distance(f: Frame, field: str, op: str, arg: object, bounds: dict) -> Frame:
    """A near condition of a find: ascending distance, ties by ``_id``."""
    inner = arg
    if isinstance(arg, dict) and "$geometry" in arg:
        bounds = bounds | {k: v for k, v in arg.items() if k in ("$maxDistance", "$minDistance")}
        unknown = [k for k in arg if k not in ("$geometry", "$maxDistance", "$minDistance")]
        if unknown:
            raise bad(f"invalid argument in geo near query: {unknown[0]}")
        inner = arg["$geometry"]
    lon, lat, metres = point_spec(inner)
    if op == "$near" and not metres:
        raise bad("$near with legacy coordinates needs a 2d index, which v1 does not have")
    scale = DOCUMENT_RADIUS if metres else 1.0
    return _within(f, field, lon, lat, scale, _bound(bounds.get("$minDistance"), "$minDistance"), _bound(bounds.get("$maxDistance"), "$maxDistance"))[0]


def geo_near(f: Frame, spec: dict) -> Frame:
    """The first stage of a pipeline: rows by distance, which goes to ``distanceField``."""
    lon, lat, metres = point_spec(spec["near"])
    scale = DOCUMENT_RADIUS if metres else 1.0
    field = spec.get("key") or _only_point(f)
    if spec.get("query"):
        f = stages.match(f, spec["query"])
    found, name = _within(f, field, lon, lat, scale, _bound(spec.get("minDistance"), "minDistance"), _bound(spec.get("maxDistance"), "maxDistance"))
    if "distanceField" in spec:
        if not isinstance(spec["distanceField"], str) or not spec["distanceField"]:
            raise bad("distanceField must be a field name")
        found = assign(found, spec["distanceField"].split("."), Value(F.col(name) * float(spec.get("distanceMultiplier", 1)), T.DoubleType()))
    if spec.get("includeLocs"):
        found = assign(found, spec["includeLocs"].split("."), compile_expr("$" + field, found.root))
    return found


def _only_point(f: Frame) -> str:
    """The one field that holds points."""
    fields = [x.name for x in f.root.type.fields if isinstance(x.dataType, T.StructType) and "coordinates" in x.dataType.fieldNames()]
    if len(fields) != 1:
        raise bad("$geoNear requires a 'key' naming the field of points unless exactly one field holds GeoJSON")
    return fields[0]
