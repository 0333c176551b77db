"""Map elements (kind, id, tags, lat, lon, refs, members) to features with geometry, by joins instead of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelark.functions.geo import METRES_PER_DEGREE
from placelark.operators import shapes
from placelark.operators.features import ALIASES, is_addressed, is_place, is_street, poi_category, tag

# Fixed values.
RING_M, STREET_M, RING_POINTS = 60.0, 150.0, 4


def diagonal_m(pts: Column) -> Column:
    lat, lon = F.transform(pts, lambda p: p["lat"]), F.transform(pts, lambda p: p["lon"])
    dy = F.array_max(lat) - F.array_min(lat)
    dx = (F.array_max(lon) - F.array_min(lon)) * F.cos(F.radians((F.array_max(lat) + F.array_min(lat)) / 2))
    return F.sqrt(dx * dx + dy * dy) * METRES_PER_DEGREE


def kept_ring(pts: Column, tags: Column) -> Column:
    """The simplified outline of what is no address and stands out by 60 m, else null."""
    return shapes.simplified(F.when(~is_addressed(tags) & (F.size(pts) >= RING_POINTS) & (diagonal_m(pts) >= RING_M), pts))


def kept_street_shape(samples: Column) -> Column:
    """A street's samples if they span 150 m, else null."""
    return F.when((F.size(samples) > 1) & (diagonal_m(samples) >= STREET_M), samples)


def features(elements: DataFrame, excluded: dict[str, list[str]] | None = None) -> DataFrame:
    """(osm_type n/w/r, osm_id, tags, category, lat, lon, ring, ring_closed).

    Nodes, ways and named multipolygons that are addresses, places or points of interest, and named streets. A way needs
    all its nodes, a mere street only its middle one: only those rows meet the nodes. Ways that only belong to relations give
    no feature of their own. Coordinates out of range and elements without any located node are dropped.
    """
    e = elements.withColumn("category", poi_category(F.col("tags"), excluded))
    tags = F.col("tags")
    wanted = is_addressed(tags) | is_place(tags) | F.col("category").isNotNull()
    nodes = e.filter("kind = 'node'")
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    none = lambda df: df.withColumn("ring", F.lit(None).cast(shapes.POINTS)).withColumn("ring_closed", F.lit(False))
    out_cols = ["osm_type", "osm_id", "tags", "category", "lat", "lon", "ring", "ring_closed"]
    out = none(nodes.filter(wanted & ok).select(F.lit("n").alias("osm_type"), F.col("id").alias("osm_id"), "tags", "category", "lat", "lon")).select(*out_cols)

    rels = e.filter("kind = 'relation'").filter(F.coalesce(tag(tags, "type") == "multipolygon", F.lit(False)) & tag(tags, "name").isNotNull() & (is_place(tags) | F.col("category").isNotNull()))
    member = rels.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("seq", "m")).filter("m.type = 'way' AND m.role IN ('outer', '')").select("rel_id", "seq", F.col("m.ref").alias("id"))
    ways = e.filter("kind = 'way' AND size(refs) > 0").withColumn("own", wanted).withColumn("street", is_street(tags))
    ways = ways.join(member.select("id").distinct().withColumn("member", F.lit(True)), "id", "left").filter("own OR street OR member")
    whole = F.col("own") | F.coalesce("member", F.lit(False))
    needed = ways.select("id", F.posexplode(F.when(whole, F.col("refs")).otherwise(F.array(F.get("refs", F.floor(F.size("refs") / 2).cast("int"))))).alias("pos", "node_id"))
    located = needed.join(nodes.filter(ok).select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    pts = located.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("p")).select("id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("pts"))
    built = ways.join(pts, "id")
    first, last = F.get("refs", 0), F.element_at("refs", -1)
    one = lambda df, kind: df.withColumn("at", shapes.representative_point(F.col("pts"))).select(F.lit(kind).alias("osm_type"), F.col("id").alias("osm_id"), "tags", "category", "at.lat", "at.lon", F.col("kept").alias("ring"), (F.col("closed") & F.col("kept").isNotNull()).alias("ring_closed"))
    own = built.filter("own OR street").withColumn("closed", first == last).withColumn("kept", kept_ring(F.when(F.col("own"), F.col("pts")), tags))
    out = out.unionByName(one(own, "w").filter(ok))

    whole_ways = built.filter("member").filter(F.size("pts") == F.size("refs")).filter(F.size("refs") >= 2).select("id", first.alias("first"), last.alias("last"), "pts")
    rings = shapes.stitched(member.join(whole_ways, "id").select("rel_id", "seq", "first", "last", "pts"))
    regions = rels.join(rings.select(F.col("rel_id").alias("id"), F.col("ring").alias("pts")), "id").withColumn("closed", F.lit(True)).withColumn("kept", kept_ring(F.col("pts"), tags))
    return out.unionByName(one(regions, "r").filter(ok))


def first_claim(feats: DataFrame, size_col: str = "extract_size") -> DataFrame:
    """One row of each element that several extracts hold: that of the largest extract, then the smallest country."""
    best = F.min_by(F.struct(*feats.columns), F.struct((-F.col(size_col)).alias("s"), "country"))
    return feats.groupBy("osm_type", "osm_id").agg(best.alias("r")).select("r.*")


def places_only(elements: DataFrame) -> DataFrame:
    """The elements that a pass over the settlements of every extract needs: named places, before any extract's other features are made. Columns and
    rows are pruned at the source; the nodes of places drawn as ways are kept with them."""
    places = elements.filter("kind <> 'node'").filter(is_place(F.col("tags")))
    refs = places.filter("kind = 'way'").select(F.explode("refs").alias("id")).distinct()
    nodes = elements.filter("kind = 'node'")
    return places.filter("kind = 'way'").unionByName(nodes.filter(is_place(F.col("tags")))).unionByName(nodes.filter(~is_place(F.col("tags"))).join(refs, "id", "left_semi").select(*elements.columns))


def build_counters(feats: DataFrame) -> DataFrame:
    """(name, n): elements that several extracts hold, and coordinates that are out of range."""
    bad = ~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    per = feats.groupBy("osm_type", "osm_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    one = per.agg(F.sum(F.col("n") - 1).alias("dedup_cross_extract"), F.sum("bad").alias("bad_coordinate"))
    return one.select(F.explode(F.map_from_arrays(F.array(F.lit("dedup_cross_extract"), F.lit("bad_coordinate")), F.array("dedup_cross_extract", "bad_coordinate"))).alias("name", "n")).withColumn("n", F.coalesce("n", F.lit(0)))


def name_profile(elements: DataFrame, top: int = 14) -> DataFrame:
    """(section, key, n) of named elements: how many there are, how many have another name, values with a semicolon; how many have each
    alias tag, languages counted together; the most frequent languages."""
    t = elements.filter(tag(F.col("tags"), "name").isNotNull()).select(F.map_filter("tags", lambda k, v: (v != "") & (k.rlike("^name:.{1,3}$") & (F.octet_length(k) <= 8) | k.isin(*ALIASES, "brand", "operator"))).alias("a"))
    semi = F.size(F.map_filter("a", lambda k, v: ~k.startswith("name:") & F.contains(v, F.lit(";"))))
    whole = t.agg(F.count(F.lit(1)).alias("named"), F.count_if(F.size("a") > 0).alias("with alias"), F.coalesce(F.sum(semi), F.lit(0)).alias("semicolons"))
    names = ["named", "with alias", "semicolons"]
    head = whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")).select(F.lit("all").alias("section"), "x.key", "x.n")
    per = t.select(F.explode(F.map_keys("a")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    tags = per.groupBy(F.when(F.col("k").startswith("name:"), "name:<lang>").otherwise(F.col("k")).alias("key")).agg(F.sum("n").alias("n")).select(F.lit("tag").alias("section"), "key", "n")
    langs = per.filter("k LIKE 'name:%'").select(F.lit("language").alias("section"), F.substring("k", 6, 8).alias("key"), "n").orderBy(F.desc("n"), "key").limit(top)
    return head.unionByName(tags).unionByName(langs)


def poi_profile(feats: DataFrame, top: int = 60) -> DataFrame:
    """(category, n, nodes, ways, addressed): the most frequent categories."""
    n = lambda c: F.count_if(c)
    return (
        feats.filter(F.col("category").isNotNull()).groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"), n(F.col("osm_type") == "n").alias("nodes"), n(F.col("osm_type") == "w").alias("ways"), n(is_addressed(F.col("tags"))).alias("addressed"))
        .orderBy(F.desc("n"), "category").limit(top)
    )


def relation_profile(elements: DataFrame) -> DataFrame:
    """One row: multipolygons, and how many are named, points of interest, addressed."""
    t = F.col("tags")
    rel = elements.filter("kind = 'relation'").filter(F.coalesce(tag(t, "type") == "multipolygon", F.lit(False)))
    return rel.agg(F.count(F.lit(1)).alias("total"), F.count_if(tag(t, "name").isNotNull()).alias("named"), F.count_if(poi_category(t).isNotNull()).alias("poi"), F.count_if(is_addressed(t)).alias("addressed"))


def key_stats(tags: DataFrame) -> DataFrame:
    """(key, n, percent): how many rows hold each key."""
    total = tags.agg(F.count(F.lit(1)).alias("total"))  # one row
    per = tags.select(F.explode(F.map_keys("tags")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(total)).select("key", "n", (100 * F.col("n") / F.col("total")).alias("percent"))
