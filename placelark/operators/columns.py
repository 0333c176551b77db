"""The index as columns of numbers: fixed-point coordinates, packed keys, term and string ids, sorted cell entries, rings of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelark.functions import geo
from placelark.operators.index import cell_listing
from placelark.operators.lineage import cut

# The scale of coordinates, rings walked at most.
SCALE, MAX_RINGS = 10_000_000, 512


def to_fixed(degrees: Column) -> Column:
    return F.round(degrees * SCALE).cast("int")


def to_degrees(fixed: Column) -> Column:
    return fixed / F.lit(float(SCALE))


def fixed_shape(shape: Column, lat: Column, lon: Column) -> Column:
    """struct<shape, min_lat, max_lat, min_lon, max_lon> in fixed point: of a flat list of coordinates, or of the point alone if it has less than two."""
    has = F.coalesce(F.size(shape) >= 4, F.lit(False))
    half = lambda k: F.filter(shape, lambda _, i: F.pmod(i, F.lit(2)) == k)
    box = [F.when(has, f(half(k))).otherwise(p) for p, k in ((lat, 0), (lon, 1)) for f in (F.array_min, F.array_max)]
    return F.struct(F.when(has, F.transform(shape, to_fixed)).alias("shape"), *[to_fixed(b).alias(n) for b, n in zip(box, ("min_lat", "max_lat", "min_lon", "max_lon"), strict=True)])


def has_shape(row_shape: Column) -> Column:
    return F.coalesce(F.size(row_shape) >= 4, F.lit(False))


def packed_element(kind: Column, osm_id: Column) -> Column:
    """An element's kind and id in one number: the kind in its two lowest bits."""
    return F.shiftleft(osm_id, 2).bitwiseOR(F.when(kind == "n", 0).when(kind == "w", 1).otherwise(2).cast("bigint"))


def unpacked_element(key: Column) -> Column:
    k = key.bitwiseAND(F.lit(3).cast("bigint"))
    return F.struct(F.when(k == 0, "n").when(k == 1, "w").otherwise("r").alias("kind"), F.shiftright(key, 2).alias("osm_id"))


def utf16_key(s: Column) -> Column:
    """Sorts as UTF-16 code units do: what lies beyond the first plane goes before the private and the compatibility letters."""
    return F.hex(F.encode(s, "UTF-16BE"))


def _ranked(values: DataFrame, order: Column) -> DataFrame:
    """values with `id`, their rank by order. Ranges of the order are ranked each in its own task, and start where those before end."""
    v = cut(values.withColumn("_o", order).repartitionByRange("_o").withColumn("_b", F.spark_partition_id()))
    starts = v.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_at", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_o")) - 1
    return v.join(F.broadcast(starts.select("_b", "_at")), "_b").withColumn("id", (F.col("_at") + own).cast("bigint")).drop("_b", "_o", "_at")  # starts: a row a range


def term_ids(terms: DataFrame) -> DataFrame:
    """(term, id): the dictionary in UTF-16 order."""
    return _ranked(terms.select("term").distinct(), utf16_key(F.col("term")))


def term_columns(posts: DataFrame) -> DataFrame:
    """(id, term, postings): the inverted index by term id, each list sorted. A term's list is one row, as in the stored form; searches join the table
    of postings instead."""
    lists = posts.groupBy("term").agg(F.array_sort(F.collect_set("anchor_id")).alias("postings"))
    return term_ids(posts).join(lists, "term")


def reversed_dictionary(terms: DataFrame) -> DataFrame:
    """(id, reversed): the dictionary read from behind, for searches by endings."""
    return _ranked(terms.select(F.reverse("term").alias("reversed")).distinct(), utf16_key(F.col("reversed")))


def anchor_terms(anchors: DataFrame, ids: DataFrame) -> DataFrame:
    """(anchor_id, place, terms): of each anchor its locality's terms (place 0), then those of each name that has any, the canonical one first and
    even if empty; -1 for words that are in no dictionary, which count for a name's length. anchors: (anchor_id, loc_tokens, names)."""
    lists = F.concat(F.array("loc_tokens"), F.slice("names", 1, 1), F.filter(F.slice("names", 2, 1 << 20), lambda v: F.size(v) > 0))
    each = anchors.select("anchor_id", F.posexplode(lists).alias("place", "words")).select("anchor_id", "place", F.posexplode_outer("words").alias("pos", "term"))
    got = each.join(ids, "term", "left").groupBy("anchor_id", "place").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(-1)).alias("id"))))).alias("t"))
    return got.select("anchor_id", "place", F.transform("t", lambda x: x["id"]).alias("terms"))


def string_table(strings: DataFrame, c: str = "s") -> DataFrame:
    """(s, id, start, length): distinct strings with ids, and where each lies in their concatenation, in bytes."""
    v = _ranked(strings.select(F.col(c).alias("s")).filter("s IS NOT NULL").distinct(), F.col("s")).withColumn("length", F.octet_length("s").cast("bigint")).withColumn("_b", F.floor(F.col("id") / 65536))
    starts = v.groupBy("_b").agg(F.sum("length").alias("c")).withColumn("_s", F.coalesce(F.sum("c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum("length").over(Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return v.join(starts.select("_b", "_s"), "_b").select("s", "id", (F.col("_s") + own).alias("start"), "length")


def grid_entries(shapes: DataFrame) -> DataFrame:
    """(cell, shape_id, at): cells' entries by cell and id, and the place of each in that order."""
    return _ranked(cell_listing(shapes).select(F.col("cell").cast("bigint").alias("cell"), "shape_id"), F.struct("cell", "shape_id")).withColumnRenamed("id", "at")


def ring_cells(lat: Column, lon: Column, ring: Column) -> Column:
    """Cells of the ring that lies `ring` cells off a point: rows by latitude, as many columns wider as a degree of longitude is shorter."""
    k = F.least(ring, F.lit(MAX_RINGS))
    wide = lambda n: F.ceil(n / F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.01)) - F.lit(1e-6)).cast("int")
    y, x = F.floor(lat / geo.CELL), F.floor(lon / geo.CELL)
    inner = F.when(k > 0, wide(k - 1)).otherwise(-1)
    cells = F.flatten(F.transform(F.sequence(-k, k), lambda dy: F.transform(F.sequence(-wide(k), wide(k)), lambda dx: F.struct(dy.alias("dy"), dx.alias("dx")))))
    edge = F.filter(cells, lambda c: (F.abs(c["dy"]) == k) | (F.abs(c["dx"]) > inner))
    return F.transform(edge, lambda c: ((y + c["dy"] + geo.ORIGIN) * geo.STRIDE + x + c["dx"] + geo.ORIGIN).cast("bigint"))
