"""Features to search records: points of interest, addresses, places and streets; tables of records as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelark.functions.text import index_tokens_each
from placelark.operators.features import alt_names, is_addressed, is_place, tag

SCHEMA = (
    "id string, layer string, name string, alt_names array<string>, house_number string, conscription string, orientation string, street string, place string, city string, postcode string, anchor_kind string, "
    "country string, lat double, lon double, shape array<double>, closed boolean, place_type string, population bigint, category string, tokens array<string>, display string"
)


def composed_number(conscription: Column, orientation: Column, provisional: Column) -> Column:
    """`conscription/orientation`, or the one there is, or the provisional one."""
    both = F.when(conscription.isNotNull() & orientation.isNotNull(), F.concat_ws("/", conscription, orientation))
    return F.coalesce(both, conscription, orientation, provisional)


def anchor_of(street: Column, place: Column) -> Column:
    """struct<name, kind>: what an address hangs off, its street, else its place, else nothing."""
    s, p = F.nullif(street, F.lit("")), F.nullif(place, F.lit(""))
    return F.struct(F.coalesce(s, p).alias("name"), F.when(s.isNotNull(), "street").when(p.isNotNull(), "place").otherwise("none").alias("kind"))


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def _unless(value: Column, other: Column) -> Column:
    return F.when(~F.coalesce(F.lower(value) == F.lower(other), F.lit(False)), value)


def from_tags(feats: DataFrame) -> DataFrame:
    """features (osm_type, osm_id, tags, category, lat, lon, ring, ring_closed, country) to records of SCHEMA: none, one, or
    two of each, where a point of interest has an address of its own. One pass, nothing shuffled."""
    t = F.col("tags")
    g = lambda k: tag(t, k)
    base = F.concat(F.lit("osm:"), "osm_type", F.col("osm_id").cast("string"))
    none = F.lit(None).cast("string")
    shape = F.when(F.size("ring") >= 4, F.flatten(F.transform("ring", lambda p: F.array(p["lat"], p["lon"]))))
    number, city = g("addr:housenumber"), F.coalesce(g("addr:city"), g("addr:place"), g("is_in:city"))

    def rec(**cols):
        names = ["id", "layer", "name", "alt_names", "house_number", "conscription", "orientation", "street", "place", "city", "postcode", "anchor_kind", "place_type", "population", "category", "display"]
        empty = {"population": F.lit(None).cast("bigint")}
        return F.struct(*[cols.get(n, empty.get(n, none)).alias(n) for n in names])

    poi = rec(
        id=F.concat(base, F.lit("#poi")), layer=F.lit("poi"), name=g("name"), alt_names=alt_names(t, poi=True), house_number=number, street=g("addr:street"), place=g("addr:place"), city=city, postcode=g("addr:postcode"), category=F.col("category"),
        display=_joined(g("name"), F.when(g("addr:street").isNotNull(), F.concat_ws(" ", g("addr:street"), number)), _unless(city, g("name"))),
    )
    con, ori = g("addr:conscriptionnumber"), g("addr:streetnumber")
    own = F.coalesce(number, composed_number(con, ori, g("addr:provisionalnumber")))
    place, town = F.coalesce(g("addr:place"), g("addr:suburb")), F.coalesce(g("addr:city"), g("addr:place"))
    anchor = F.coalesce(g("addr:street"), place)
    kind = F.when(g("addr:street").isNotNull(), "street").when(place.isNotNull(), "place").otherwise("none")
    address = rec(
        id=base, layer=F.lit("address"), alt_names=alt_names(t), house_number=own, conscription=con, orientation=ori, street=g("addr:street"), place=place, city=town, postcode=g("addr:postcode"), anchor_kind=kind,
        display=_joined(F.nullif(F.concat_ws(" ", anchor, own), F.lit("")), _unless(town, anchor)),
    )
    town_rec = rec(id=base, layer=F.lit("place"), name=g("name"), alt_names=alt_names(t), city=g("name"), postcode=g("addr:postcode"), place_type=g("place"), population=F.coalesce(F.replace(g("population"), F.lit(" "), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint")), display=g("name"))
    street = rec(id=base, layer=F.lit("street"), name=g("name"), alt_names=alt_names(t), street=g("name"), city=city, postcode=g("addr:postcode"), anchor_kind=F.lit("street"), display=_joined(g("name"), city))
    other = F.when(is_addressed(t), address).when(is_place(t), F.when(F.col("category").isNull(), town_rec)).when(g("name").isNotNull() & g("highway").isNotNull(), street)
    rows = feats.withColumn("r", F.explode(F.array_compact(F.array(F.when(F.col("category").isNotNull(), poi), other)))).filter("r.display IS NOT NULL")
    out = rows.select("r.*", "country", "lat", "lon", shape.alias("shape"), (F.coalesce("ring_closed", F.lit(False)) & shape.isNotNull()).alias("closed"))
    return with_tokens(out).select(*[x.split()[0] for x in SCHEMA.split(", ")])


def with_tokens(rows: DataFrame) -> DataFrame:
    """tokens: what a user might type of a record, each once, in order."""
    some = lambda *cs: F.array(*[F.coalesce(F.col(c), F.lit("")) for c in cs])
    none = F.array().cast("array<string>")
    numbers = F.when(F.col("layer").isin("address", "poi"), some("house_number", "conscription", "orientation", "postcode")).otherwise(none)
    texts = F.filter(F.concat(some("name", "street", "place", "city"), F.coalesce("alt_names", none), numbers), lambda x: x != "")
    return rows.withColumn("tokens", F.array_distinct(F.flatten(index_tokens_each(texts))))


def attach_locality(rows: DataFrame, bound: DataFrame) -> DataFrame:
    """Records with the city of their settlement (id, settlement) where they lack one: addresses without city and place,
    points of interest without city, unless the settlement has their own name. Display and tokens follow."""
    j = rows.join(bound, "id", "left")
    orphan = ((F.col("layer") == "address") & F.col("city").isNull() & F.col("place").isNull()) | ((F.col("layer") == "poi") & F.col("city").isNull() & ~F.col("settlement").eqNullSafe(F.col("name")))
    take = orphan & F.col("settlement").isNotNull()
    j = j.withColumn("display", F.when(take, F.concat_ws(", ", "display", "settlement")).otherwise(F.col("display"))).withColumn("city", F.when(take, F.col("settlement")).otherwise(F.col("city")))
    return with_tokens(j.drop("settlement")).select(*rows.columns)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path, compression="gzip")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=SCHEMA, mode="FAILFAST")
