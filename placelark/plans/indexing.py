"""From records to the tables of the index: duplicates collapsed, streets grouped, localities attached, addresses bound, counted.

Identifiers are 64-bit hashes of keys, so that an address knows its street's anchor without a join, and reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelark.functions.priors import place_prior, poi_prior
from placelark.functions.text import tokens
from placelark.operators import index, records
from placelark.operators.extract import kept_street_shape
from placelark.operators.features import best_of, catchment, dedup_places, dedup_pois, group_streets
from placelark.operators.lineage import cut

LAYERS = {"street": 0, "place": 1, "poi": 2}
# Fixed value: cells that keep settlements of one name apart, in degrees.
PLACE_CELL = 0.25


def _words(c: Column) -> Column:
    return F.array_join(tokens(F.coalesce(c, F.lit(""))), " ")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")


def localities(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(id, settlement): the name of the settlement that claims each row (id, country, lat, lon)."""
    p = places.select("id", "country", "place_type", "lat", "lon", "name")
    got = catchment(rows.select("id", "country", "lat", "lon"), p.withColumnRenamed("id", "place_id"), keep_all=False).select("id", "place_id")
    return got.join(p.select(F.col("id").alias("place_id"), F.col("name").alias("settlement")), "place_id").select("id", "settlement")


def street_records(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Segments of streets, grouped by country, name and locality, where a locality is the tag's or else the settlement's around. A street takes the
    names of its first segment, the sample nearest the mean, and its samples as an open shape if they span enough."""
    bare = segments.filter("city IS NULL OR city = ''")
    s = segments.join(localities(bare, places), "id", "left").withColumn("city", F.coalesce(F.nullif("city", F.lit("")), "settlement")).drop("settlement")
    g = group_streets(s.select(F.col("id").alias("seq"), "country", F.coalesce("street", "name").alias("name"), F.col("city").alias("locality"), "lat", "lon"), key=tokens)
    shape = F.flatten(F.transform(kept_street_shape(F.col("samples")), lambda p: F.array(p["lat"], p["lon"])))
    own = g.select(F.col("seq").alias("id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), shape.alias("_shape"))
    out = s.join(own, "id").withColumn("lat", F.col("_lat")).withColumn("lon", F.col("_lon")).withColumn("shape", F.col("_shape")).withColumn("closed", F.lit(False)).withColumn("display", F.concat_ws(", ", "name", "city"))
    return records.with_tokens(out.drop("_lat", "_lon", "_shape")).select(*segments.columns)


def curated(rows: DataFrame) -> DataFrame:
    """Records of one import, made ready for the index: settlements and points of interest once each, streets grouped, and localities attached
    to addresses and points of interest that lack one."""
    rows = cut(rows)  # read by each layer, and places by all of them
    of = lambda layer: rows.filter(F.col("layer") == layer)
    places = cut(dedup_places(of("place"), key=tokens))
    lone = dedup_pois(of("poi"), key=tokens).unionByName(of("address"))
    orphan = lone.filter("(city IS NULL OR city = '') AND (layer = 'poi' OR place IS NULL OR place = '')")
    return street_records(of("street"), places).unionByName(places).unionByName(records.attach_locality(lone, localities(orphan, places)))


def dedup_anchors(rows: DataFrame) -> DataFrame:
    """Records of streets, settlements and points of interest with anchor_id, layer number and prior, one a key: a settlement's name in a cell, a
    street's name and locality, a point's id. Of settlements the largest prior stays, else the first."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.nullif("street", F.lit("")))
    r = rows.filter(F.col("layer").isin(*LAYERS)).withColumn("name", name).filter("name IS NOT NULL")
    cell = lambda c: F.floor(F.col(c) / PLACE_CELL).cast("string")
    key = F.when(F.col("layer") == "poi", F.concat(F.lit("poi|"), "id")).when(F.col("layer") == "place", F.concat_ws("|", "country", F.lit("p"), _words(F.col("name")), cell("lat"), cell("lon")))
    r = r.withColumn("_k", key.otherwise(street_key(F.col("country"), F.col("name"), F.col("city"))))
    prior = F.when(F.col("layer") == "place", place_prior(F.col("place_type"), F.col("population"))).when(F.col("layer") == "poi", poi_prior(F.col("category"))).otherwise(F.lit(1.0))
    r = r.withColumn("prior", prior)
    first = best_of(r, F.col("_k"), -F.when(F.col("layer") == "place", F.col("prior")).otherwise(F.lit(0.0)), F.col("id"))
    number = F.coalesce(*[F.when(F.col("layer") == k, v) for k, v in LAYERS.items()])
    return first.withColumn("anchor_id", F.xxhash64("_k")).withColumn("layer", number.cast("int"))


def street_key(country: Column, name: Column, locality: Column) -> Column:
    return F.concat_ws("|", country, F.lit("s"), _words(name), _words(locality))


_ANCHOR = ["anchor_id", "layer", "country", "name", "locality", "alt_names", "category", "prior", "lat", "lon"]


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """anchors, addresses and shapes for `Geocoder.build`, and counters (name, n), from curated records.

    An address goes to the nearest settlement of its place's name, or else makes one of its own; or to the street of its name and
    locality, which it makes if no street has that key. A street made so lies in the middle of its addresses. Addresses without
    either are counted and left out.
    """
    known = cut(dedup_anchors(rows))
    real = known.select("anchor_id", "layer", "country", "name", F.coalesce("city", F.lit("")).alias("locality"), "alt_names", "category", "prior", "lat", "lon", "shape", "closed")
    hung = rows.filter("layer = 'address'").withColumn("_at", records.anchor_of(F.col("street"), F.col("place")))
    hung = cut(hung.select(F.xxhash64("id").alias("address_id"), "country", "house_number", "city", "lat", "lon", F.col("_at.name").alias("at"), F.col("_at.kind").alias("kind")))
    on_street = hung.filter("kind = 'street'").withColumn("anchor_id", F.xxhash64(street_key(F.col("country"), F.col("at"), F.col("city"))))
    made = on_street.join(real.filter("layer = 0").select("anchor_id"), "anchor_id", "left_anti")
    spot = index.centroids(made).select("anchor_id", (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"))
    first = made.groupBy("anchor_id").agg(F.min_by(F.struct("country", "at", "city"), "address_id").alias("r"))
    none = lambda kind: F.lit(None).cast(kind)
    synthetic = lambda df, layer, country, name, city: df.select("anchor_id", F.lit(layer).alias("layer"), country.alias("country"), name.alias("name"), F.coalesce(city, F.lit("")).alias("locality"), none("array<string>").alias("alt_names"), none("string").alias("category"), F.lit(1.0).alias("prior"), "lat", "lon")
    streets = synthetic(first.join(spot, "anchor_id"), 0, F.col("r.country"), F.col("r.at"), F.col("r.city"))
    at_place = hung.filter("kind = 'place'")
    bound = index.bind_places(at_place.withColumnRenamed("at", "place"), real.filter("layer = 1"), key=tokens)
    at_place = at_place.join(bound, "address_id", "left").withColumn("_bound", F.col("anchor_id").isNotNull()).withColumn("anchor_id", F.coalesce("anchor_id", F.xxhash64(F.lit("place of"), "address_id")))
    places = synthetic(at_place.filter("NOT _bound"), 1, F.col("country"), F.col("at"), F.col("city"))
    addresses = on_street.unionByName(at_place.drop("_bound")).select("address_id", "anchor_id", "house_number", "lat", "lon")
    ring = F.transform(F.sequence(F.lit(0), F.floor(F.size("shape") / 2).cast("int") - 1), lambda i: F.struct(F.get("shape", i * 2).alias("lat"), F.get("shape", i * 2 + 1).alias("lon")))
    drawn = real.filter("size(shape) >= 4").select(F.col("anchor_id").alias("shape_id"), F.coalesce("closed", F.lit(False)).alias("closed"), ring.alias("ring"))
    of = lambda c, f: f(F.transform("ring", lambda p: p[c]))
    shapes = drawn.select("*", *[of(c, f).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.array_min), ("max", F.array_max))])
    counts = [_count(known.filter(F.col("layer") == v), f"anchor_{k}") for k, v in LAYERS.items()]
    counts += [_count(hung.filter("kind = 'none'"), "address_no_anchor"), _count(at_place.filter("_bound"), "address_bound_to_place"), _count(places, "anchor_synthetic_place"), _count(first, "anchor_synthetic_street")]
    dup = rows.filter(F.col("layer").isin(*LAYERS) & (F.coalesce(F.nullif("name", F.lit("")), F.nullif("street", F.lit(""))).isNotNull())).agg(F.count(F.lit(1)).alias("n")).join(known.agg(F.count(F.lit(1)).alias("m"))).select(F.lit("anchor_duplicate_key").alias("name"), (F.col("n") - F.col("m")).alias("n"))
    return {"anchors": real.select(*_ANCHOR).unionByName(streets).unionByName(places), "addresses": addresses, "shapes": shapes, "counters": reduce(DataFrame.unionByName, counts, dup)}


def from_features(feats: DataFrame) -> dict[str, DataFrame]:
    """The tables from features of several extracts (with country and extract_size): an element that two of them hold is the larger one's."""
    from placelark.operators.extract import first_claim

    if "extract_size" in feats.columns:
        feats = first_claim(feats)
    return tables(cut(curated(records.from_tags(feats))))  # read by each table


