"""Shapes: rings stitched from member ways, simplified outlines, representative points. Sequential by nature, so each
feature's points go through an Arrow function; features spread over tasks, and one feature is one row."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<lat:double,lon:double>>"
# Fixed values.
TOLERANCE_M, MAX_POINTS, METRES = 10.0, 48, 111320.0


def shoelace(pts) -> float:
    return abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(pts, pts[1:], strict=False))) / 2


def stitch(ways: list[dict]) -> list[tuple[float, float]]:
    """The largest closed ring of ways joined at shared end nodes, reversed where needed; empty without one."""
    left, best = [(w["first"], w["last"], [(p["lat"], p["lon"]) for p in w["pts"]]) for w in ways], []
    while left:
        first, last, pts = left.pop(0)
        while first != last:
            for i, (a, b, more) in enumerate(left):
                if last in (a, b):
                    more = more if a == last else more[::-1]
                    last = b if a == last else a
                    pts = pts + more[1:]
                    del left[i]
                    break
            else:
                break
        if first == last and len(pts) >= 4 and (not best or shoelace(pts) > shoelace(best)):
            best = pts
    return best


def simplify(pts: list[tuple[float, float]], tolerance: float = TOLERANCE_M, most: int = MAX_POINTS) -> list[tuple[float, float]]:
    """Points that stand off the line between kept neighbours by more than the tolerance, doubled until `most` are left."""

    def run(tol):
        keep, stack = {0, len(pts) - 1}, [(0, len(pts) - 1)]
        k = math.cos(math.radians(pts[0][0])) * METRES
        while stack:
            a, b = stack.pop()
            (ay, ax), (by, bx) = pts[a], pts[b]
            dx, dy = (bx - ax) * k, (by - ay) * METRES
            far, at = tol, None
            for i in range(a + 1, b):
                x, y = (pts[i][1] - ax) * k, (pts[i][0] - ay) * METRES
                n = dx * dx + dy * dy
                t = max(0.0, min(1.0, (x * dx + y * dy) / n)) if n else 0.0
                d = math.hypot(x - t * dx, y - t * dy)
                if d > far:
                    far, at = d, i
            if at is not None:
                keep.add(at)
                stack += [(a, at), (at, b)]
        return [pts[i] for i in sorted(keep)]

    if len(pts) < 3:
        return list(pts)
    out = run(tolerance)
    while len(out) > most:
        tolerance *= 2
        out = run(tolerance)
    return out


def representative(pts: list[tuple[float, float]]) -> tuple[float, float] | None:
    """The area centroid; the mean of the vertices if the area is nothing or the centroid is outside the box; the first
    point of what is no polygon."""
    if not pts:
        return None
    if len(pts) < 3:
        return pts[0]
    k = math.cos(math.radians(pts[0][0]))
    a = x = y = 0.0
    oy, ox = pts[0]  # about the first vertex: far from zero the products would cancel
    own = [(p[0] - oy, p[1] - ox) for p in pts]
    for (y0, x0), (y1, x1) in zip(own, own[1:] + own[:1], strict=True):
        c = (x0 * y1 - x1 * y0) * k
        a, x, y = a + c, x + (x0 + x1) * k * c, y + (y0 + y1) * c
    mean = (sum(p[0] for p in pts) / len(pts), sum(p[1] for p in pts) / len(pts))
    if abs(a) < 2e-12:
        return mean
    lat, lon = oy + y / (3 * a), ox + x / (3 * a) / k
    inside = min(p[0] for p in pts) <= lat <= max(p[0] for p in pts) and min(p[1] for p in pts) <= lon <= max(p[1] for p in pts)
    return (lat, lon) if inside else mean


def _struct(pts):
    return [{"lat": a, "lon": b} for a, b in pts]


def _mapped(f, kind: str):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda r: None if r is None else f(r))

    return run


def _points(ring):
    return [(p["lat"], p["lon"]) for p in ring]


def stitched(members: DataFrame) -> DataFrame:
    """members (rel_id, seq, first, last, pts) to (rel_id, ring)."""
    w = members.groupBy("rel_id").agg(F.array_sort(F.collect_list(F.struct("seq", "first", "last", "pts"))).alias("ways"))
    return w.select("rel_id", _mapped(lambda x: _struct(stitch(list(x))), POINTS)("ways").alias("ring")).filter(F.size("ring") > 0)


def simplified(ring: Column) -> Column:
    return _mapped(lambda r: _struct(simplify(_points(r))), POINTS)(ring)


def representative_point(ring: Column) -> Column:
    """struct<lat, lon>: the area centroid; the mean of the vertices if the area is nothing or the centroid is outside the box; the first
    point of what is no polygon; null without points. Built-in functions only; sums go about the first vertex: far from zero
    the products would cancel."""
    n, o = F.size(ring), F.get(ring, 0)
    k = F.cos(F.radians(o["lat"]))
    edges = F.transform(ring, lambda p, i: F.struct((p["lat"] - o["lat"]).alias("y0"), (p["lon"] - o["lon"]).alias("x0"), (F.get(ring, F.pmod(i + 1, n))["lat"] - o["lat"]).alias("y1"), (F.get(ring, F.pmod(i + 1, n))["lon"] - o["lon"]).alias("x1")))

    def add(acc, e):
        c = (e["x0"] * e["y1"] - e["x1"] * e["y0"]) * k
        return F.struct((acc["a"] + c).alias("a"), (acc["x"] + (e["x0"] + e["x1"]) * k * c).alias("x"), (acc["y"] + (e["y0"] + e["y1"]) * c).alias("y"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    each = lambda c: F.transform(ring, lambda p: p[c])
    mean = point(*[F.aggregate(each(c), F.lit(0.0), lambda acc, x: acc + x) / n for c in ("lat", "lon")])

    def from_sums(g):
        lat, lon = o["lat"] + g["y"] / (3 * g["a"]), o["lon"] + g["x"] / (3 * g["a"]) / k
        within = lat.between(F.array_min(each("lat")), F.array_max(each("lat"))) & lon.between(F.array_min(each("lon")), F.array_max(each("lon")))
        return F.when(F.abs(g["a"]) < 2e-12, mean).when(within, point(lat, lon)).otherwise(mean)

    sums = F.aggregate(edges, zero, add)
    return F.when(n < 1, F.lit(None)).when(n < 3, point(o["lat"], o["lon"])).otherwise(F.get(F.transform(F.array(sums), from_sums), 0))
