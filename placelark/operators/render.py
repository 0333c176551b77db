"""Results as GeoJSON, and checks of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelark.functions import geo


def request_error(df: DataFrame) -> Column:
    """null for a valid request (q, lat, lon, limit, radius, country), else what is wrong with it."""
    c = F.col
    both = c("lat").isNotNull() & c("lon").isNotNull()
    return (
        F.when(c("q").isNotNull() & both, "q and a point")
        .when(c("q").isNull() & ~both, "neither q nor a point")
        .when(~F.char_length("q").between(1, 200), "length of q")
        .when(~c("lat").between(-90, 90) | ~c("lon").between(-180, 180), "coordinates")
        .when(~c("limit").between(1, 50), "limit")
        .when(~c("radius").between(1, 50000), "radius")
        .when(~c("country").rlike("^[A-Za-z]{2}$"), "country")
        .when(~c("proximity").rlike(PROXIMITY) if "proximity" in df.columns else F.lit(False), "proximity")
    )


# Fixed value: a point as `lat,lon`.
PROXIMITY = r"^-?\d{1,2}(\.\d+)?,-?\d{1,3}(\.\d+)?$"


def respond(requests: DataFrame, geocoder) -> DataFrame:
    """requests (request_id, q, lat, lon, limit, radius, country, proximity) to (request_id, status, json): 400 with what is wrong, or 200 with a
    FeatureCollection, empty where nothing was found. An unknown country is wrong; a text that was corrected, and a point that looks
    transposed, are said in `query`. Requests of one kind are one batch; a request's own limit cuts its results."""
    r = requests.withColumn("error", request_error(requests))
    known = geocoder.t["coverage"].select(F.col("country").alias("_c"))
    r = r.join(known, F.lower("country") == F.col("_c"), "left").withColumn("error", F.coalesce("error", F.when(F.col("country").isNotNull() & F.col("_c").isNull(), F.concat(F.lit("unknown country "), "country")))).drop("_c")
    bad = r.filter("error IS NOT NULL").select("request_id", F.lit(400).alias("status"), F.to_json(F.struct("error")).alias("json"))
    ok = r.filter("error IS NULL")
    near = F.split("proximity", ",")
    asked = ok.filter("q IS NOT NULL").select(F.col("request_id").alias("query_id"), "q", "country", F.get(near, 0).cast("double").alias("lat"), F.get(near, 1).cast("double").alias("lon"))
    words = geocoder.forward(asked, limit=50)
    points = ok.filter("q IS NULL").select(F.col("request_id").alias("point_id"), "lat", "lon", "country")
    names = geocoder.t["anchors"].select("anchor_id", "name", F.col("country").alias("_country"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    spots = geocoder.reverse(points, limit=50, radius=50000.0).join(names, "anchor_id")
    want = ok.select("request_id", F.coalesce("limit", F.when(F.col("q").isNotNull(), 10).otherwise(5)).alias("most"), F.coalesce("radius", F.lit(5000.0)).alias("reach"))
    found = words.select(F.col("query_id").alias("request_id"), "rank", "anchor_id", "name", "country", "score", "lat", "lon", "corrected", F.lit(0.0).alias("distance_m"))
    found = found.unionByName(spots.select(F.col("point_id").alias("request_id"), "rank", "anchor_id", "name", F.col("_country").alias("country"), "score", F.col("alat").alias("lat"), F.col("alon").alias("lon"), F.lit(None).cast("string").alias("corrected"), "distance_m"))
    found = found.join(want, "request_id").filter("rank <= most AND distance_m <= reach")
    each = feature(found.withColumn("query_id", F.col("request_id"))).groupBy(F.col("query_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "json"))).alias("f"))
    said = found.groupBy("request_id").agg(F.max("corrected").alias("corrected"))
    box = geocoder.t["coverage"].agg(*[f(c).alias(c) for f, cs in ((F.min, ("min_lat", "min_lon")), (F.max, ("max_lat", "max_lon"))) for c in cs])
    swapped = geo.looks_transposed(F.col("lat"), F.col("lon"), *[F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")])
    out = ok.join(each, "request_id", "left").join(said, "request_id", "left").join(F.broadcast(box))  # box is one row
    hint = F.when(F.col("f").isNull() & F.col("q").isNull() & swapped, "lat and lon may be transposed")
    query = F.to_json(F.struct(F.when(F.col("q").isNotNull(), "forward").otherwise("reverse").alias("type"), "q", "lat", "lon", "corrected", hint.alias("hint")))
    return bad.unionByName(out.select("request_id", F.lit(200).alias("status"), F.concat(F.lit('{"type":"FeatureCollection","query":'), query, F.lit(',"features":['), F.coalesce(F.array_join(F.transform("f", lambda x: x["json"]), ","), F.lit("")), F.lit("]}")).alias("json")))


def feature(df: DataFrame) -> DataFrame:
    """(query_id, rank, json): one GeoJSON feature a row, coordinates to 1e-7, relevance to 1e-4."""
    r = lambda x, k: F.floor(x * k + 0.5) / k
    geometry = F.struct(F.lit("Point").alias("type"), F.array(r(F.col("lon"), 1e7), r(F.col("lat"), 1e7)).alias("coordinates"))
    props = F.struct("name", "country", r(F.col("score"), 1e4).alias("relevance"))
    return df.select("query_id", "rank", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("anchor_id").alias("id"), geometry.alias("geometry"), props.alias("properties"))).alias("json"))


def collection(features: DataFrame) -> DataFrame:
    """One FeatureCollection a query; a query has 50 results at most."""
    f = features.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "json"))).alias("f"))
    return f.select("query_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("f", lambda x: x["json"]), ","), F.lit("]}")).alias("json"))
