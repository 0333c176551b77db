"""Distances, cells and shapes as column expressions. Rings are arrays of struct<lat, lon> in degrees or scaled integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_M, METRES_PER_DEGREE, CELL, ORIGIN, STRIDE = 6371008.8, 111320.0, 0.05, 4096, 16384


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell_key(lat: Column, lon: Column) -> Column:
    return (F.floor(lat / CELL) + ORIGIN) * STRIDE + F.floor(lon / CELL) + ORIGIN


def reach(metres: Column) -> Column:
    """Degrees of latitude that cover a distance, a little more."""
    return F.degrees(metres / EARTH_M) * 1.0001


def near_rows(lat: Column, metres: Column, step: Column) -> Column:
    """Rows of height `step` within a distance."""
    return F.sequence(F.floor((lat - reach(metres)) / step), F.floor((lat + reach(metres)) / step))


def column_of(lon: Column, n: Column) -> Column:
    """The column of a longitude, of n round the globe."""
    return F.pmod(F.floor((lon + 180) * n / 360), n.cast("long"))


def near_columns(lat: Column, lon: Column, metres: Column, n: Column) -> Column:
    """Columns of n round the globe within a distance: the more, the nearer to a pole; all, if it lies within."""
    s, c = F.sin(F.radians(reach(metres))), F.cos(F.radians(lat))
    wide = F.when(s < c, F.degrees(F.asin(F.least(s / c, F.lit(1.0)))) * 1.0001).otherwise(F.lit(180.0))
    lo, hi = F.floor((lon - wide + 180) * n / 360), F.floor((lon + wide + 180) * n / 360)
    return F.transform(F.sequence(lo, F.least(hi, lo + n.cast("long") - 1)), lambda x: F.pmod(x, n.cast("long")))


def bbox_distance_m(lat, lon, min_lat, min_lon, max_lat, max_lon) -> Column:
    zero = F.lit(0.0)
    dy = F.greatest(min_lat - lat, lat - max_lat, zero) * METRES_PER_DEGREE
    dx = F.greatest(min_lon - lon, lon - max_lon, zero) * METRES_PER_DEGREE * F.cos(F.radians(lat))
    return F.sqrt(dx * dx + dy * dy)


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, F.pmod(i + 1, n)).alias("b")))


def contains(ring: Column, lat: Column, lon: Column) -> Column:
    """Even-odd ray cast by cross products, without division."""

    def flips(e):
        ay, ax, by, bx = e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"]
        cross = (bx - ax) * (lat - ay) - (lon - ax) * (by - ay)
        return ((ay > lat) != (by > lat)) & (F.when(by > ay, cross > 0).otherwise(cross < 0))

    return (F.size(ring) >= 3) & (F.size(F.filter(_edges(ring), flips)) % 2 == 1)


def ring_area_m2(ring: Column) -> Column:
    """Shoelace in metres about the first vertex."""
    o = F.get(ring, 0)
    x = lambda p: (p["lon"] - o["lon"]) * METRES_PER_DEGREE * F.cos(F.radians(o["lat"]))
    y = lambda p: (p["lat"] - o["lat"]) * METRES_PER_DEGREE
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda acc, e: acc + x(e["a"]) * y(e["b"]) - x(e["b"]) * y(e["a"]))) / 2


def distance_to_shape_m(ring: Column, closed: Column, lat: Column, lon: Column) -> Column:
    """To the nearest edge of a ring; to the nearest vertex of an open shape; null without points."""
    k = METRES_PER_DEGREE * F.cos(F.radians(lat))
    x = lambda p: (p["lon"] - lon) * k
    y = lambda p: (p["lat"] - lat) * METRES_PER_DEGREE

    def seg(e):
        ax, ay, bx, by = x(e["a"]), y(e["a"]), x(e["b"]), y(e["b"])
        dx, dy = bx - ax, by - ay
        d = dx * dx + dy * dy
        t = F.when(d == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(d, F.lit(0.0)))))
        return F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2)

    edge = F.array_min(F.transform(_edges(ring), seg))
    vertex = F.array_min(F.transform(ring, lambda p: x(p) * x(p) + y(p) * y(p)))
    return F.sqrt(F.when(closed & (F.size(ring) >= 3), edge).otherwise(vertex))


def looks_transposed(lat, lon, min_lat, min_lon, max_lat, max_lon) -> Column:
    inside = lambda a, b: a.between(min_lat, max_lat) & b.between(min_lon, max_lon)
    return ~inside(lat, lon) & inside(lon, lat)
