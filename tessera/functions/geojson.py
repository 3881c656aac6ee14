"""GeoJSON shapes on the sphere: parsing, checking, and predicates between them.

Points are judged by columns alone. Lines and polygons need great-circle edges, which columns can't follow; an Arrow
function with numpy judges these, behind a box of latitude and longitude that columns test first.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import bad
from tessera.functions.sphere import haversine, near_box, point_of
from tessera.functions.values import Value

# Shape types and the depth of their coordinates.
DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
TOUCH = 1e-12


class Shape:
    """Points, lines and polygons as unit vectors. A polygon is a list of rings, the first the shell, without the closing point."""

    def __init__(self) -> None:
        self.points: list[np.ndarray] = []
        self.lines: list[np.ndarray] = []
        self.polygons: list[list[np.ndarray]] = []


def vector(lon: float, lat: float) -> np.ndarray:
    a, b = math.radians(lon), math.radians(lat)
    return np.array([math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)])


def _position(p: object) -> np.ndarray:
    if not isinstance(p, (list, tuple)) or len(p) < 2 or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in p[:2]):
        raise bad("Point must only contain numeric elements")
    lon, lat = float(p[0]), float(p[1])
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise bad(f"Longitude/latitude is out of bounds, lng: {lon:g} lat: {lat:g}")
    return vector(lon, lat)


def _line(ps: object) -> np.ndarray:
    if not isinstance(ps, (list, tuple)) or len(ps) < 2:
        raise bad("GeoJSON LineString must have at least 2 vertices")
    v = np.array([_position(p) for p in ps])
    keep = np.concatenate(([True], np.abs(np.diff(v, axis=0)).max(1) > TOUCH))
    if keep.sum() < 2:
        raise bad("GeoJSON LineString must have at least 2 distinct vertices")
    return v[keep]


def _ring(ps: object) -> np.ndarray:
    if not isinstance(ps, (list, tuple)) or len(ps) < 4:
        raise bad("Loop must have at least 3 different vertices")
    if list(ps[0])[:2] != list(ps[-1])[:2]:
        raise bad("Loop is not closed")
    v = np.array([_position(p) for p in ps[:-1]])
    v = v[np.concatenate(([True], np.abs(np.diff(v, axis=0)).max(1) > TOUCH))]
    if len(v) < 3:
        raise bad("Loop must have at least 3 different vertices")
    n = len(v)
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            if _cross(v[i], v[(i + 1) % n], v[j], v[(j + 1) % n]):
                raise bad(f"Edges {i} and {j} cross")
    return v


def parse_shape(x: object) -> Shape:
    """A shape from GeoJSON, as text or values, or from a legacy pair. Mistakes raise."""
    if isinstance(x, str):
        x = json.loads(x)
    out = Shape()
    if isinstance(x, (list, tuple)):
        out.points.append(_position(x))
        return out
    if not isinstance(x, dict):
        raise bad("geo element must be an array or object")
    if "type" not in x and "coordinates" not in x and len(x) >= 2:
        out.points.append(_position(list(x.values())))
        return out
    kind, c = x.get("type"), x.get("coordinates")
    if kind == "GeometryCollection":
        parts = x.get("geometries")
        if not isinstance(parts, (list, tuple)) or not parts:
            raise bad("GeometryCollection geometries must be a nonempty array")
        for p in parts:
            s = parse_shape(p)
            out.points += s.points
            out.lines += s.lines
            out.polygons += s.polygons
        return out
    if kind not in DEPTH:
        raise bad(f"unknown GeoJSON type: {json.dumps(x)}")
    if not isinstance(c, (list, tuple)):
        raise bad(f"GeoJSON {kind} coordinates must be an array")
    if kind == "Point":
        out.points.append(_position(c))
    elif kind == "MultiPoint":
        out.points += [_position(p) for p in c]
    elif kind == "LineString":
        out.lines.append(_line(c))
    elif kind == "MultiLineString":
        out.lines += [_line(p) for p in c]
    else:
        for rings in [c] if kind == "Polygon" else c:
            if not rings:
                raise bad("Polygon has no loops")
            out.polygons.append([_ring(r) for r in rings])
    return out


# ---- great-circle geometry


def _side(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> float:
    return float(np.dot(np.cross(a, b), p))


def _on_edge(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> bool:
    n = np.cross(a, b)
    length = np.linalg.norm(n)
    if length < TOUCH:
        return float(np.abs(a - p).max()) < TOUCH
    if abs(np.dot(n, p)) / length > 1e-11:
        return False
    return np.dot(np.cross(n, a), p) >= -TOUCH and np.dot(np.cross(b, n), p) >= -TOUCH


def _cross(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    """Whether two edges meet at an inner point of both."""
    s = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    if s[0] * s[1] >= 0 or s[2] * s[3] >= 0:
        return False
    x = np.cross(np.cross(a, b), np.cross(c, d))
    return bool(np.dot(x, a + b) * np.dot(x, c + d) > 0)


def _meet(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    return _cross(a, b, c, d) or _on_edge(a, b, c) or _on_edge(a, b, d) or _on_edge(c, d, a) or _on_edge(c, d, b)


def edges_of(v: np.ndarray, closed: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(v)
    for i in range(n if closed else n - 1):
        yield v[i], v[(i + 1) % n]


def ring_holds(ring: np.ndarray, p: np.ndarray) -> bool:
    """Whether a point lies in the smaller of the two regions that a ring makes, its edge included: the angles under
    which the ring's edges are seen from the point add up to a whole turn."""
    for a, b in edges_of(ring, True):
        if _on_edge(a, b, p):
            return True
    centre = ring.sum(0)
    if np.dot(p, centre) <= 0 and np.linalg.norm(centre) > TOUCH and all(np.dot(v, centre) > 0 for v in ring):
        return False  # on the far half of the sphere
    q = ring - np.outer(ring @ p, p)
    angles = np.arctan2(np.cross(q, np.roll(q, -1, 0)) @ p, np.einsum("ij,ij->i", q, np.roll(q, -1, 0)))
    return abs(angles.sum()) > math.pi


def polygon_holds(rings: list[np.ndarray], p: np.ndarray) -> bool:
    if not ring_holds(rings[0], p):
        return False
    return not any(ring_holds(h, p) and not any(_on_edge(a, b, p) for a, b in edges_of(h, True)) for h in rings[1:])


def _polygon_edges(rings: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [e for r in rings for e in edges_of(r, True)]


def _edges_cross(xs: list, ys: list) -> bool:
    return any(_cross(*x, *y) for x in xs for y in ys)


def within(shape: Shape, polygons: list[list[np.ndarray]]) -> bool:
    """Whether every part lies inside one polygon each, edges included."""

    def path_in(v: np.ndarray, closed: bool, rings: list[np.ndarray]) -> bool:
        return all(polygon_holds(rings, p) for p in v) and not _edges_cross(list(edges_of(v, closed)), _polygon_edges(rings))

    def polygon_in(inner: list[np.ndarray], rings: list[np.ndarray]) -> bool:
        return path_in(inner[0], True, rings) and not any(ring_holds(inner[0], h.mean(0) / np.linalg.norm(h.mean(0))) and not any(ring_holds(x, h[0]) for x in inner[1:]) for h in rings[1:])

    some = shape.points or shape.lines or shape.polygons
    return bool(some) and all(any(polygon_holds(r, p) for r in polygons) for p in shape.points) and all(any(path_in(v, False, r) for r in polygons) for v in shape.lines) and all(any(polygon_in(s, r) for r in polygons) for s in shape.polygons)


def intersects(a: Shape, b: Shape) -> bool:
    """Whether any part of one meets any part of the other."""
    for x, y in ((a, b), (b, a)):
        for p in x.points:
            if any(np.abs(p - q).max() < TOUCH for q in y.points) or any(_on_edge(s, t, p) for v in y.lines for s, t in edges_of(v, False)) or any(polygon_holds(r, p) for r in y.polygons):
                return True
        for v in x.lines:
            if any(polygon_holds(r, v[0]) for r in y.polygons):
                return True
        for r in x.polygons:
            if any(polygon_holds(s, r[0][0]) for s in y.polygons):
                return True
    lines = lambda s: [e for v in s.lines for e in edges_of(v, False)] + [e for r in s.polygons for e in _polygon_edges(r)]
    xs, ys = lines(a), lines(b)
    return any(_meet(*x, *y) for x in xs for y in ys)


def bounds(shape: Shape) -> tuple[np.ndarray, float]:
    """A cap that holds a shape: its centre and angle, a little widened for edges that bulge."""
    v = np.concatenate([*(p[None] for p in shape.points), *shape.lines, *(r[0] for r in shape.polygons)])
    centre = v.sum(0)
    n = np.linalg.norm(centre)
    centre = centre / n if n > TOUCH else np.array([0.0, 0.0, 1.0])
    angle = float(np.arccos(np.clip(v @ centre, -1, 1)).max())
    # an edge bulges by less than half its length beyond its ends
    return centre, min(math.pi, angle * 1.5 + 1e-9)


# ---- filter conditions


def geo_condition(op: str, spec: object, v: Value) -> Column:
    """``$geoWithin`` or ``$geoIntersects`` of one value; null where it has no shape."""
    if not isinstance(spec, dict) or len([k for k in spec]) < 1:
        raise bad(f"{op} requires an object argument")
    if "$centerSphere" in spec:
        if op != "$geoWithin":
            raise bad("$geoIntersects needs a $geometry")
        return in_cap(spec["$centerSphere"], v)
    if "$geometry" not in spec:
        raise bad(f"unknown geo specifier: {next(iter(spec))}")
    shape = parse_shape(spec["$geometry"])
    if op == "$geoWithin" and (shape.points or shape.lines or not shape.polygons):
        raise bad("$geoWithin not supported with provided geometry")
    return _judge(op, spec["$geometry"], shape, v)


def in_cap(arg: object, v: Value) -> Column:
    """All vertices lie within an angle of a centre."""
    if not isinstance(arg, list) or len(arg) != 2 or isinstance(arg[1], bool) or not isinstance(arg[1], (int, float)):
        raise bad("$centerSphere needs a centre and a radius")
    if arg[1] < 0:
        raise bad("radius must be a non-negative number")
    centre = list(arg[0].values()) if isinstance(arg[0], dict) else arg[0]
    _position(centre)
    lon0, lat0, angle = float(centre[0]), float(centre[1]), float(arg[1])
    if _holds_points(v):
        lon, lat = point_of(v)
        return near_box(lon, lat, (lon0, lat0), angle) & (haversine(F.lit(lon0), F.lit(lat0), lon, lat) <= angle)
    at = vector(lon0, lat0)

    @F.arrow_udf("boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if s is None else all(math.acos(max(-1.0, min(1.0, float(p @ at)))) <= angle + 1e-12 for p in np.concatenate([*(q[None] for q in s.points), *s.lines, *(r[0] for r in s.polygons)])) for s in map(_shape_or_none, batch.to_pylist())], pa.bool_())

    return judge(_as_text(v))


def _holds_points(v: Value) -> bool:
    """Whether the type can hold points only."""
    if isinstance(v.type, T.StructType) and "coordinates" in v.type.fieldNames():
        kind = v.type["coordinates"].dataType
        return isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.ArrayType)
    return isinstance(v.type, T.ArrayType) or isinstance(v.type, T.StructType)


def _as_text(v: Value) -> Column:
    return F.lit(None).cast("string") if v.missing else v.col if isinstance(v.type, T.StringType) else F.to_json(v.col)


def _shape_or_none(text: str | None) -> Shape | None:
    if text is None:
        return None
    try:
        return parse_shape(text)
    except ValueError:
        return None


def _judge(op: str, spec: object, shape: Shape, v: Value) -> Column:
    if v.missing:
        return F.lit(None).cast("boolean")
    text = json.dumps(spec)

    @F.arrow_udf("boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        query = parse_shape(text)
        for batch in batches:
            shapes = map(_shape_or_none, batch.to_pylist())
            yield pa.array([None if s is None else within(s, query.polygons) if op == "$geoWithin" else intersects(s, query) for s in shapes], pa.bool_())

    if not _holds_points(v):
        return judge(_as_text(v))
    # points outside the shape's cap needn't leave the JVM
    centre, angle = bounds(shape)
    lon0, lat0 = math.degrees(math.atan2(centre[1], centre[0])), math.degrees(math.asin(max(-1.0, min(1.0, centre[2]))))
    lon, lat = point_of(v)
    return F.when(lon.isNotNull() & near_box(lon, lat, (lon0, lat0), angle), judge(F.to_json(F.array(lon, lat)))).otherwise(F.lit(False))
