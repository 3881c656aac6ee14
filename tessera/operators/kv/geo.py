"""Places in scored sets: a member's score is its cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geohash
from tessera.functions.sphere import KEY_RADIUS, UNITS, near_box
from tessera.operators.kv.base import KeySpace, Written, fail, integer, number
from tessera.operators.kv.zsets import scored, zadd, zmscore


def _place(lon: object, lat: object) -> tuple[float, float]:
    x, y = number(lon), number(lat)
    if not (-180 <= x <= 180 and -geohash.LAT_RANGE <= y <= geohash.LAT_RANGE):
        raise fail(f"invalid longitude,latitude pair {x:.6f},{y:.6f}")
    return x, y


def cell_of(lon: float, lat: float) -> int:
    """A position's cell, for single values given in a command."""

    def spread(v: int) -> int:
        return sum((v >> i & 1) << 2 * i for i in range(geohash.STEPS))

    def steps(v: float, low: float, high: float) -> int:
        return min(int((v - low) / (high - low) * (1 << geohash.STEPS)), (1 << geohash.STEPS) - 1)

    return spread(steps(lat, -geohash.LAT_RANGE, geohash.LAT_RANGE)) | spread(steps(lon, -180.0, 180.0)) << 1


def geoadd(s: KeySpace, key: str, *args: object) -> Written:
    flags = []
    rest = list(args)
    while rest and str(rest[0]).upper() in ("NX", "XX", "CH"):
        flags.append(rest.pop(0))
    if not rest or len(rest) % 3:
        raise fail("syntax error")
    pairs = []
    for i in range(0, len(rest), 3):
        pairs += [cell_of(*_place(rest[i], rest[i + 1])), rest[i + 2]]
    return zadd(s, key, *flags, *pairs)


def positioned(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``score``) and ``lon``, ``lat`` of their cells' centres."""
    lon, lat = geohash.decode(F.col("score"))
    kept = [F.col(c) for c in rows.columns]
    return rows.select(*kept, geohash.let(F.struct(lon.alias("lon"), lat.alias("lat")), lambda p: p).alias("__p")).select(*kept, "__p.lon", "__p.lat")


def geopos(s: KeySpace, key: str, *members: str) -> DataFrame:
    return positioned(zmscore(s, key, *members)).select("at", "member", "lon", "lat")


def geohashes(s: KeySpace, key: str, *members: str) -> DataFrame:
    return zmscore(s, key, *members).select("at", "member", geohash.name(F.col("score")).alias("hash"))


def _unit(name: object) -> str:
    if str(name).lower() not in UNITS:
        raise fail("unsupported unit provided. please use M, KM, FT, MI")
    return str(name).lower()


def geodist(s: KeySpace, key: str, a: str, b: str, unit: str = "m") -> DataFrame:
    u = _unit(unit)
    at = positioned(scored(s, key))
    x = at.where(F.col("member") == a).select(F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lit(1).alias("one"))
    y = at.where(F.col("member") == b).select(F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.lit(1).alias("one"))
    d = geohash.distance(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    return x.join(y, "one").select(geohash.in_unit(d, u).alias("reply"))


def within_radius(rows: DataFrame, centre: tuple[float, float], metres: float) -> DataFrame:
    """``rows`` (with ``lon``, ``lat``) within a distance, and their ``metres``. A box goes first, to prune by."""
    d = geohash.distance(F.lit(centre[0]), F.lit(centre[1]), F.col("lon"), F.col("lat"))
    near = near_box(F.col("lon"), F.col("lat"), centre, min(metres / KEY_RADIUS * (1 + 1e-9), math.pi))
    return rows.withColumn("metres", F.when(near, d)).where(F.col("metres") <= metres)


def within_box(rows: DataFrame, centre: tuple[float, float], width: float, height: float) -> DataFrame:
    d = geohash.distance(F.lit(centre[0]), F.lit(centre[1]), F.col("lon"), F.col("lat"))
    return rows.where(geohash.in_box(F.col("lon"), F.col("lat"), centre, width, height)).withColumn("metres", d)


class _Search:
    """A search's options."""

    def __init__(self, s: KeySpace, key: str, args: list[object], stored: bool):
        self.centre: tuple[float, float] | None = None
        self.radius: float | None = None
        self.box: tuple[float, float] | None = None
        self.unit, self.order, self.count, self.any, self.dist = "m", None, None, False, False
        args = list(args)
        while args:
            o = str(args.pop(0)).upper()
            if o == "FROMMEMBER" and args and self.centre is None:
                self.centre = member_place(s, key, str(args.pop(0)))
            elif o == "FROMLONLAT" and len(args) >= 2 and self.centre is None:
                self.centre = _place(args.pop(0), args.pop(0))
            elif o == "BYRADIUS" and len(args) >= 2 and self.radius is None and self.box is None:
                self.radius, self.unit = number(args.pop(0)), _unit(args.pop(0))
            elif o == "BYBOX" and len(args) >= 3 and self.radius is None and self.box is None:
                self.box, self.unit = (number(args.pop(0)), number(args.pop(0))), _unit(args.pop(0))
            elif o in ("ASC", "DESC"):
                self.order = o
            elif o == "COUNT" and args:
                self.count = integer(args.pop(0))
                if self.count <= 0:
                    raise fail("COUNT must be > 0")
                if args and str(args[0]).upper() == "ANY":
                    args.pop(0)
                    self.any = True
            elif o == "ANY":
                raise fail("the ANY argument requires COUNT argument")
            elif o == "STOREDIST" and stored:
                self.dist = True
            elif o not in ("WITHCOORD", "WITHDIST", "WITHHASH") or stored:
                raise fail("syntax error")
        if self.centre is None:
            raise fail("exactly one of FROMMEMBER or FROMLONLAT can be specified for geosearch")
        if self.radius is None and self.box is None:
            raise fail("exactly one of BYRADIUS and BYBOX can be specified for geosearch")
        if (self.radius or 0) < 0 or self.box and min(self.box) < 0:
            raise fail("radius cannot be negative" if self.box is None else "height or width cannot be negative")

    def rows(self, s: KeySpace, key: str) -> DataFrame:
        """``member``, ``score``, ``dist``, ``lon``, ``lat`` of what is found, in order."""
        at, m = positioned(scored(s, key)), UNITS[self.unit]
        found = within_radius(at, self.centre, self.radius * m) if self.box is None else within_box(at, self.centre, self.box[0] * m, self.box[1] * m)
        if self.order or self.count and not self.any:
            found = found.orderBy(F.desc("metres") if self.order == "DESC" else F.asc("metres"), "member")
        if self.count:
            found = found.limit(self.count)
        return found.select("member", "score", geohash.in_unit(F.col("metres"), self.unit).alias("dist"), "lon", "lat", (F.col("metres") / m).alias("__exact"))


def member_place(s: KeySpace, key: str, member: str) -> tuple[float, float]:
    row = positioned(scored(s, key).where(F.col("member") == member)).first()
    if row is None:
        raise fail("could not decode requested zset member")
    return row["lon"], row["lat"]


def geosearch(s: KeySpace, key: str, *args: object) -> DataFrame:
    return _Search(s, key, list(args), False).rows(s, key).drop("__exact")


def geosearchstore(s: KeySpace, dst: str, src: str, *args: object) -> Written:
    search = _Search(s, src, list(args), True)
    rows = search.rows(s, src)
    kept = rows.select("member", (F.col("__exact") if search.dist else F.col("score")).alias("score"))
    return Written(s.put("zset", dst, kept, 0), kept.agg(F.count(F.lit(1)).alias("reply")))


def _radius(member: bool, read_only: bool):
    def run(s: KeySpace, key: str, *args: object) -> DataFrame | Written:
        args = list(args)
        head = ["FROMMEMBER", args.pop(0)] if member else ["FROMLONLAT", args.pop(0), args.pop(0)]
        head += ["BYRADIUS", args.pop(0), args.pop(0)]
        rest, store = [], None
        while args:
            o = args.pop(0)
            if str(o).upper() in ("STORE", "STOREDIST") and not read_only and args:
                store = (str(o).upper(), str(args.pop(0)))
            else:
                rest.append(o)
        if store is None:
            return geosearch(s, key, *head, *rest)
        return geosearchstore(s, store[1], key, *head, *rest, *(["STOREDIST"] if store[0] == "STOREDIST" else []))

    return run


georadius, georadius_ro = _radius(False, False), _radius(False, True)
georadiusbymember, georadiusbymember_ro = _radius(True, False), _radius(True, True)


def cells(lon: Column, lat: Column) -> Column:
    """Cells of positions, for whole tables."""
    return geohash.encode(lon, lat).cast("double")
