"""52-bit geohash cells as columns: 26 bits an axis, latitude in the even bits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.sphere import KEY_RADIUS, UNITS

# The range of latitudes of scores, steps an axis, and the letters of cell names.
LAT_RANGE, STEPS, LETTERS = 85.05112878, 26, "0123456789bcdefghjkmnpqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(move: Callable, shift: int, mask: int) -> Callable[[Column], Column]:
    return lambda v: v.bitwiseOR(move(v, shift)).bitwiseAND(F.lit(mask))


def _spread(bits: Column) -> Column:
    """26 bits moved to the even places of 52."""
    x = bits.cast("bigint")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = let(x, _folded(F.shiftleft, shift, mask))
    return x


def _gather(x: Column) -> Column:
    """The even places of 52 bits as 26 bits."""
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = let(x, _folded(F.shiftright, shift, mask))
    return x


def _steps(value: Column, low: float, high: float) -> Column:
    cells = float(1 << STEPS)
    return F.least(F.floor((value - low) / (high - low) * cells).cast("bigint"), F.lit((1 << STEPS) - 1))


def encode(lon: Column, lat: Column, lat_range: float = LAT_RANGE) -> Column:
    """The cell of a position; null outside the ranges."""
    ok = lon.between(-180.0, 180.0) & lat.between(-lat_range, lat_range)
    return F.when(ok, _spread(_steps(lat, -lat_range, lat_range)).bitwiseOR(F.shiftleft(_spread(_steps(lon, -180.0, 180.0)), 1)))


def decode(cell: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's centre."""
    cell = cell.cast("bigint")
    size = float(1 << STEPS)

    def centre(steps: Column, low: float, high: float) -> Column:
        def middle(v: Column) -> Column:
            lo = F.lit(low) + v / F.lit(size) * F.lit(high - low)
            hi = F.lit(low) + (v + 1) / F.lit(size) * F.lit(high - low)
            return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), (lo + hi) / 2)))  # no cell, no position

        return let(steps, middle)

    return centre(_gather(F.shiftright(cell, 1)), -180.0, 180.0), centre(_gather(cell), -LAT_RANGE, LAT_RANGE)


def name(cell: Column) -> Column:
    """The cell's standard name of 11 letters, which runs over all latitudes; the last letter is always ``0``."""
    lon, lat = decode(cell)
    standard = let(F.struct(lon.alias("x"), lat.alias("y")), lambda p: encode(p["x"], p["y"], 90.0))
    spell = lambda v: F.concat(*[F.substring(F.lit(LETTERS), (F.shiftright(v, 52 - 5 * (i + 1)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(10)], F.lit("0"))
    return let(standard, spell)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two positions; on one meridian the arc of latitude."""
    a, b = F.radians(lat1), F.radians(lat2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    u = F.sin((b - a) / 2)
    return F.when(v == 0.0, F.lit(KEY_RADIUS) * F.abs(b - a)).otherwise(2.0 * KEY_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(u * u + F.cos(a) * F.cos(b) * v * v))))


def in_box(lon: Column, lat: Column, centre: tuple[float, float], width: float, height: float) -> Column:
    """Within a box of metres: the arc of latitude, and the arc along the member's parallel."""
    x, y = F.lit(centre[0]), F.lit(centre[1])
    return (distance(x, y, x, lat) <= height / 2) & (distance(lon, lat, x, lat) <= width / 2)


def in_unit(metres: Column, unit: str) -> Column:
    """Metres in a unit, to four places, half to even."""
    if unit not in UNITS:
        raise ValueError("unsupported unit provided. please use M, KM, FT, MI")
    return F.bround(metres / UNITS[unit], 4)
