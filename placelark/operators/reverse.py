"""Reverse geocoding in batches: containing regions, then the nearest in escalating radii."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelark.functions import geo
from placelark.operators.index import cell_listing
from placelark.operators.lineage import cut

MAX_CONTAINING = 3


def once_each(points: DataFrame, search, on: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """search(points) for all points, where those that agree in `on` are searched once: rows of a location go to every point_id there.
    The search sees the location itself as point_id, so its rows must not depend on that. Points are never broadcast: Spark takes their size from
    compressed files, and a broadcast passes the driver."""
    at = F.struct(*on)
    found = search(points.select(*on).distinct().withColumn("point_id", at))
    return points.select("point_id", at.alias("_at")).hint("merge").join(found.withColumnRenamed("point_id", "_at"), "_at").select(*found.columns)


def containing(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(point_id, shape_id, area_m2): cells meet in an equi-join; boxes and rings refine. The listing is never broadcast: it holds a ring for each
    cell, far more than the compressed files that Spark takes its size from. Its rows stream past a cell's points."""
    p = points.select("point_id", F.col("lat").alias("plat"), F.col("lon").alias("plon")).withColumn("cell", geo.cell_key(F.col("plat"), F.col("plon")))
    s = cell_listing(shapes.withColumn("area_m2", geo.ring_area_m2(F.col("ring")))).drop("lat", "lon")
    box = F.col("plat").between(F.col("min_lat"), F.col("max_lat")) & F.col("plon").between(F.col("min_lon"), F.col("max_lon"))
    return s.hint("merge").join(p, "cell").filter(box).filter(geo.contains(F.col("ring"), F.col("plat"), F.col("plon"))).select("point_id", "shape_id", "area_m2")


def top_containing(found: DataFrame, n: int = MAX_CONTAINING) -> DataFrame:
    w = Window.partitionBy("point_id").orderBy("area_m2", "shape_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def nearest(points: DataFrame, features: DataFrame, limit: int = 5, radius: float = 5000.0, on: tuple[str, ...] = ()) -> DataFrame:
    """(point_id, feature_id, distance_m, rank): the nearest within the radius. The first round of 150 m, 600 m ... that finds
    `limit` ends a point's search: the points left go on against a coarser grid, so a dense area is never searched wide.
    Columns `on`, of both sides, must be equal. Each round's hits are checkpointed: its points and the next round's follow from them."""
    r, out, left = min(150.0, radius), None, points
    while True:
        step = r / geo.METRES_PER_DEGREE
        n = F.lit(max(1, int(360 * math.cos(math.radians(66)) / step)))
        p = left.select("point_id", *on, F.col("lat").alias("plat"), F.col("lon").alias("plon")).withColumn("cy", F.explode(geo.near_rows(F.col("plat"), F.lit(r), F.lit(step)))).withColumn("cx", F.explode(geo.near_columns(F.col("plat"), F.col("plon"), F.lit(r), n)))
        f = features.select("feature_id", *on, "lat", "lon").withColumn("cy", F.floor(F.col("lat") / step)).withColumn("cx", geo.column_of(F.col("lon"), n))
        d = geo.haversine_m(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
        hits = p.join(f, ["cy", "cx", *on]).withColumn("distance_m", d).filter(F.col("distance_m") <= r).select("point_id", "feature_id", "distance_m")
        last = r >= radius
        hits = hits if last else cut(hits)
        enough = hits.groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit).select("point_id")
        done = hits if last else hits.join(enough, "point_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        left = left.join(enough, "point_id", "left_anti")
        r = min(r * 4, radius)
    w = Window.partitionBy("point_id").orderBy("distance_m", "feature_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
