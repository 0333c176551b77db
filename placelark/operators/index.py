"""The index: postings, frequencies, address binding, runs, coverage and cells, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelark.functions import geo
from placelark.functions.text import fold, native_index_tokens
from placelark.operators.lineage import cut


def own_terms() -> Column:
    """An anchor's terms, distinct."""
    return F.array_distinct(F.concat(*[native_index_tokens(F.col(c)) for c in ("name", "locality", "alias")]))


def postings(anchors: DataFrame) -> DataFrame:
    """(term, anchor_id), distinct. Terms of one anchor are distinct by array, so nothing is shuffled."""
    return anchors.select(F.explode(own_terms()).alias("term"), "anchor_id")


def term_df(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: DataFrame, n_anchors: DataFrame) -> DataFrame:
    """ln(1 + N / (500 + df)); n_anchors is one row (n)."""
    return df.join(F.broadcast(n_anchors)).withColumn("idf", F.log(1 + F.col("n") / (500 + F.col("df")))).drop("n")


def leading_int(s: Column) -> Column:
    """The store's reading: first digits; 0 without any, 0 above 2**32 - 1, 2**31 at most."""
    v = F.regexp_extract(s, "[0-9]+", 0).try_cast("bigint")
    return F.when(v.isNull() | (v > 4294967295), 0).otherwise(F.least(v, F.lit(2147483648))).cast("bigint")


def bind_streets(addresses: DataFrame, anchors: DataFrame) -> DataFrame:
    """addresses (address_id, country, street, city) to street anchors by country, folded name and folded locality; a key
    without an anchor makes one, of the id -(smallest address id) - 1."""
    key = lambda name, loc: F.concat_ws("|", "country", fold(F.col(name)), fold(F.col(loc)))
    known = anchors.withColumn("key", key("name", "locality")).groupBy("key").agg(F.min("anchor_id").alias("known_id"))
    own = addresses.withColumn("key", key("street", "city"))
    made = own.join(known, "key", "left_anti").groupBy("key").agg((-F.min("address_id") - 1).alias("made_id"))
    return own.join(known, "key", "left").join(made, "key", "left").select("address_id", F.coalesce("known_id", "made_id").alias("anchor_id"), F.col("known_id").isNull().alias("synthetic"))


def bind_places(addresses: DataFrame, places: DataFrame, key=lambda c: F.array(fold(c)), few: int = 32) -> DataFrame:
    """addresses (address_id, country, place, lat, lon) to the nearest place of the same name, by planar distance
    scaled at the address; ties to the smallest id; without a place, none. `key`: what names are compared by, an array of words.

    Names of up to `few` places meet them all. Others have a grid of their own, some four places a cell: an address meets the nine cells about it, and
    is settled if its nearest there is no farther than what lies outside can be. The rest go on to cells of four times the side, then meet all."""
    group = ["country", "k"]
    p = places.select("country", key(F.col("name")).alias("k"), "anchor_id", F.col("lat").alias("plat"), F.col("lon").alias("plon")).groupBy(*group, "plat", "plon").agg(F.min("anchor_id").alias("anchor_id"))
    span = F.greatest(F.max("plat") - F.min("plat"), F.max("plon") - F.min("plon"))
    stats = p.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), span.alias("span"), F.count_if(F.isnull("plat") | F.isnull("plon")).alias("unplaced"))
    dense = (F.col("n") > few) & (F.col("span") > 0) & ~F.isnan("span") & (F.col("unplaced") == 0)
    stats = cut(stats.select(*group, F.when(dense, F.col("span") / F.sqrt(F.col("n") / 4)).alias("step")))
    p = cut(p.join(stats, group))
    left = cut(addresses.select("address_id", "country", key(F.col("place")).alias("k"), "lat", "lon").join(stats, group))
    dx, dy = (F.col("plon") - F.col("lon")) * F.cos(F.radians("lat")), F.col("plat") - F.col("lat")
    nearest = F.min(F.struct((dx * dx + dy * dy).alias("d"), "anchor_id")).alias("b")
    out = None
    for times in (1, 4):
        step = F.col("step") * times
        cell = lambda c: F.floor(F.col(c) / step)  # noqa: E731, B023
        about = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))  # noqa: E731, B023
        near = left.filter("step IS NOT NULL").withColumn("cy", cell("lat")).withColumn("cx", cell("lon")).withColumn("reach", F.pow(step * F.cos(F.radians("lat")), F.lit(2)) * (1 - 1e-9)).drop("step")
        tiles = p.filter("step IS NOT NULL").withColumn("cy", about("plat")).withColumn("cx", about("plon")).drop("step")
        hits = near.join(tiles, [*group, "cy", "cx"]).groupBy("address_id").agg(nearest, F.min("reach").alias("reach"))
        done = cut(hits.filter(F.col("b.d") <= F.col("reach")).select("address_id", F.col("b.anchor_id").alias("anchor_id")))
        left = left.join(done, "address_id", "left_anti")
        out = done if out is None else out.unionByName(done)
    return out.unionByName(left.drop("step").join(p.drop("step"), group).groupBy("address_id").agg(nearest).select("address_id", F.col("b.anchor_id").alias("anchor_id")))


def address_runs(addresses: DataFrame) -> DataFrame:
    """(anchor_id, n, first): a run's length, and its offset among runs ordered by anchor. Offsets are sums of sums by range of
    ids, whatever their gaps: one row a range is ordered as a whole, and a range's anchors in its own task."""
    counts = addresses.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("anchor_id").withColumn("b", F.spark_partition_id())
    counts = cut(counts)  # a range's number must not change
    by_block = counts.groupBy("b").agg(F.sum("n").alias("s"))
    starts = by_block.withColumn("start", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    own = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("anchor_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.join(F.broadcast(starts), "b").select("anchor_id", "n", (F.col("start") + own).alias("first"))  # a row a range


def centroids(addresses: DataFrame) -> DataFrame:
    e7 = lambda c: F.round(F.col(c) * 1e7).cast("bigint")
    return addresses.groupBy("anchor_id").agg(*[(F.sum(e7(c)) / F.count(F.lit(1))).cast("bigint").alias(f"{c}_e7") for c in ("lat", "lon")])


def coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("country").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])


def cell_listing(shapes: DataFrame) -> DataFrame:
    """(cell, shape_id) of closed shapes of 30 m or more, over the cells their boxes touch."""
    big = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon")) * geo.METRES_PER_DEGREE >= 30
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / geo.CELL), F.floor(F.col(b) / geo.CELL)))
    return shapes.filter(F.col("closed") & big).withColumn("cy", cells("min_lat", "max_lat")).withColumn("cx", cells("min_lon", "max_lon")).withColumn("cell", (F.col("cy") + geo.ORIGIN) * geo.STRIDE + F.col("cx") + geo.ORIGIN).drop("cy", "cx")
