"""Distances and points on the sphere, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import Value, class_of

# The earth's radius in metres for documents and for scored keys, and unit lengths.
DOCUMENT_RADIUS, KEY_RADIUS = 6378100.0, 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """The angle between two points given in degrees."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v)))


def point_of(v: Value) -> tuple[Column, Column]:
    """Longitude and latitude of a GeoJSON point, a legacy pair, or a document of two numbers; null if it is none."""
    none = F.lit(None).cast("double")
    if v.missing:
        return none, none
    if isinstance(v.type, T.ArrayType) and class_of(v.type.elementType) == "number":
        return F.get(v.col, F.lit(0)).cast("double"), F.get(v.col, F.lit(1)).cast("double")
    if isinstance(v.type, T.StructType):
        names = v.type.fieldNames()
        if "coordinates" in names:
            pair = v.col["coordinates"]
            kind = v.type["coordinates"].dataType
            if isinstance(kind, T.ArrayType) and class_of(kind.elementType) == "number":
                point = F.when(v.col["type"] == "Point", pair) if "type" in names else pair
                return F.get(point, F.lit(0)).cast("double"), F.get(point, F.lit(1)).cast("double")
        elif len(names) >= 2 and all(class_of(v.type[n].dataType) == "number" for n in names[:2]):
            return v.col[names[0]].cast("double"), v.col[names[1]].cast("double")
    return none, none


def box_of(lon: float, lat: float, angle: float) -> tuple[float, float, float | None]:
    """Least and largest latitude, and half the width in degrees of longitude (None: all), of a cap."""
    lo, hi = lat - math.degrees(angle), lat + math.degrees(angle)
    if lo <= -90 or hi >= 90 or angle >= math.pi / 2:
        return max(lo, -90.0), min(hi, 90.0), None
    half = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    return lo, hi, half


def near_box(lon: Column, lat: Column, centre: tuple[float, float], angle: float) -> Column:
    """A cheap test that everything within ``angle`` of a point passes; the scan can prune by it."""
    lo, hi, half = box_of(*centre, angle)
    out = lat.between(lo - 1e-9, hi + 1e-9)
    if half is None or half >= 180:
        return out
    west, east = centre[0] - half - 1e-9, centre[0] + half + 1e-9
    if west < -180:
        return out & ((lon >= west + 360) | (lon <= east))
    if east > 180:
        return out & ((lon >= west) | (lon <= east - 360))
    return out & lon.between(west, east)
