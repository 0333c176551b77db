"""From tagged features to records: classes, categories, names, localities, duplicates, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelark.functions import geo
from placelark.functions.priors import CATCHMENT_KM, lookup, settlement_rank
from placelark.functions.text import native_tokens

# Fixed values.
STREETS = "motorway trunk primary secondary tertiary unclassified residential living_street pedestrian road".split()
PLACES = "city town village hamlet suburb quarter neighbourhood borough isolated_dwelling municipality".split()
POI_KEYS = "amenity shop tourism leisure historic office healthcare craft railway aeroway public_transport man_made natural waterway mountain_pass".split()
#: By key, the values that are furniture of the map rather than a destination.
EXCLUDED = {
    "amenity": "parcel_locker atm charging_station parking parking_space parking_entrance bench waste_basket waste_disposal recycling vending_machine bicycle_parking bicycle_repair_station motorcycle_parking shelter drinking_water toilets hunting_stand grit_bin post_box telephone clock fountain bbq water_point fire_hydrant street_lamp lounger photo_booth device_charging_station".split(),
    "tourism": ["information"],
    "public_transport": "platform stop_position stop_area stop_area_group".split(),
    "railway": "rail platform platform_edge stop switch signal level_crossing crossing buffer_stop milestone razed abandoned disused construction proposed yard turntable traverser derail tram subway narrow_gauge light_rail preserved monorail funicular spur siding crossover owner_change".split(),
    "historic": "yes wayside_shrine wayside_cross boundary_stone milestone survey_point".split(),
    "leisure": "pitch playground fitness_station picnic_table slipway firepit bleachers outdoor_seating common bandstand".split(),
    "man_made": "monitoring_station surveillance pipeline storage_tank mast antenna utility_pole street_cabinet manhole pole cutline embankment adit petroleum_well silo gasometer flagpole cairn survey_point beacon crane works".split(),
    "aeroway": "runway taxiway apron hangar holding_position parking_position navigationaid windsock gate".split(),
    "shop": ["vacant", "no"],
    "natural": "tree tree_row scrub grassland heath wetland rock stone sand coastline shingle bare_rock scree hedge earth_bank shrub tree_stump gully sinkhole crevasse".split(),
    "waterway": "stream ditch drain weir lock_gate riverbank fish_pass turning_point water_point fuel".split(),
}
ALIASES = "alt_name short_name official_name old_name loc_name int_name nat_name reg_name nickname".split()


def tag(tags: Column, key: str) -> Column:
    return F.nullif(F.try_element_at(tags, F.lit(key)), F.lit(""))


def is_addressed(tags: Column) -> Column:
    return F.coalesce(tag(tags, "addr:housenumber"), tag(tags, "addr:conscriptionnumber"), tag(tags, "addr:provisionalnumber")).isNotNull()


def is_street(tags: Column) -> Column:
    return F.coalesce(tag(tags, "name").isNotNull() & tag(tags, "highway").isin(*STREETS), F.lit(False))


def is_place(tags: Column) -> Column:
    return F.coalesce(tag(tags, "name").isNotNull() & tag(tags, "place").isin(*PLACES), F.lit(False))


def poi_category(tags: Column, excluded: dict[str, list[str]] | None = None) -> Column:
    """key=value of the first key in order whose value counts; null for unnamed, disused or former features."""
    out = EXCLUDED if excluded is None else excluded
    ok = [F.when((tag(tags, k) != "no") & ~tag(tags, k).isin(*out.get(k, [""])), F.concat(F.lit(k + "="), tag(tags, k))) for k in POI_KEYS]
    gone = F.lit(False)
    for k in ("disused", "abandoned", "demolished"):
        gone = gone | F.coalesce(tag(tags, k) == "yes", F.lit(False))
    return F.when(tag(tags, "name").isNotNull() & ~gone & tag(tags, "was").isNull(), F.coalesce(*ok))


def alt_names(tags: Column, poi: bool = False) -> Column:
    """Names in other languages and alias tags, split at `;`, trimmed, distinct, sorted, without the own name."""
    keys = ALIASES + (["brand", "operator"] if poi else [])
    lang = F.map_filter(tags, lambda k, v: k.rlike("^name:[^:]{1,3}$") & (F.octet_length(k) <= 8) | k.isin(*keys))
    names = F.flatten(F.transform(F.map_values(lang), lambda v: F.transform(F.split(v, ";"), lambda x: F.trim(x))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: (x != "") & ~x.eqNullSafe(tag(tags, "name")))))


def catchment(rows: DataFrame, places: DataFrame, keep_all: bool = True) -> DataFrame:
    """rows (id, country, lat, lon) with the settlement that minimises distance / catchment, at most 1. Each place is listed in
    the cells of its own class's grid, so small classes are not searched wide; ties: wider class, then smaller id."""
    p = places.withColumn("km", lookup(F.col("place_type"), CATCHMENT_KM, None)).filter("km IS NOT NULL")
    p = p.select("country", "km", F.col("lat").alias("plat"), F.col("lon").alias("plon"), "place_id")
    step = lambda km: F.greatest(km / 111.32, F.lit(0.005))
    n = lambda km: F.floor(120 / step(km))  # noqa: E731  columns three times as wide as high
    p = p.withColumn("cy", F.explode(geo.near_rows(F.col("plat"), F.col("km") * 1000, step(F.col("km"))))).withColumn("cx", F.explode(geo.near_columns(F.col("plat"), F.col("plon"), F.col("km") * 1000, n(F.col("km")))))
    classes = sorted(set(CATCHMENT_KM.values()))
    r = rows.withColumn("km", F.explode(F.array(*[F.lit(x) for x in classes]))).withColumn("cy", F.floor(F.col("lat") / step(F.col("km")))).withColumn("cx", geo.column_of(F.col("lon"), n(F.col("km"))))
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")) / 1000
    best = r.join(p, ["country", "km", "cy", "cx"]).withColumn("s", d / F.col("km")).filter("s <= 1").groupBy("id").agg(F.min(F.struct("s", (-F.col("km")).alias("k"), "place_id"))["place_id"].alias("place_id"))
    return rows.join(best, "id", "left" if keep_all else "inner")


def group_streets(segments: DataFrame, key=native_tokens) -> DataFrame:
    """Segments (seq, country, name, locality, lat, lon) to streets (country, k, l: tokens of name and locality; seq of the first, n, lat, lon,
    samples): the count, and of the first 16 the one nearest the mean."""
    keys = ["country", "k", "l"]
    s = segments.withColumn("k", F.array_join(key(F.col("name")), " ")).withColumn("l", F.array_join(key(F.coalesce("locality", F.lit(""))), " "))
    # the first 16 by window limit, so that a street of any number of segments gathers 16 rows
    first = s.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).filter("rn <= 16").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("samples"))
    mean = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"), F.min("seq").alias("seq"))
    d = lambda x: F.pow(x["lat"] - F.col("mlat"), 2) + F.pow((x["lon"] - F.col("mlon")) * F.cos(F.radians("mlat")), 2)
    nearest = F.array_min(F.transform("samples", lambda x: F.struct(d(x).alias("d"), x["seq"].alias("seq"), x["lat"].alias("lat"), x["lon"].alias("lon"))))
    return mean.join(first, keys).withColumn("r", nearest).select(*keys, "seq", "n", F.col("r.lat").alias("lat"), F.col("r.lon").alias("lon"), F.transform("samples", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("samples"))


def _key(name: Column, *parts: Column, key=native_tokens) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.array_join(key(F.coalesce(name, F.lit(""))), " "))


def best_of(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row of each key, the smallest by order, combined map-side: a key with many rows is one row a task."""
    return rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def dedup_pois(pois: DataFrame, key=native_tokens) -> DataFrame:
    """Points of interest mapped twice: one of a country, category, name and cell of a thousandth of a degree, that with the most tokens; then the smallest id."""
    at = [F.floor(F.col(c) * 1000 + 0.5) for c in ("lat", "lon")]
    return best_of(pois, _key(F.col("name"), F.col("country"), F.col("category"), *at, key=key), -F.size("tokens"), F.col("id"))


def dedup_places(places: DataFrame, key=native_tokens) -> DataFrame:
    """Settlements mapped twice: one of a country, name and cell of a hundredth of a degree, that of the highest rank; then the smallest id."""
    at = [F.floor(F.col(c) * 100 + 0.5) for c in ("lat", "lon")]
    return best_of(places, _key(F.col("name"), F.col("country"), *at, key=key), -settlement_rank(F.col("place_type"), F.col("population")), F.col("id"))


def keep_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row of each key, the first by order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def combo_stats(tags: DataFrame, n: int = 8) -> DataFrame:
    """The most frequent combinations of keys, with a sample."""
    combo = F.array_join(F.array_sort(F.map_keys("tags")), "+")
    return tags.groupBy(combo.alias("combo")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("sample")).orderBy(F.desc("n"), "combo").limit(n)


def place_name(name: Column, number: Column, locality: Column, country: Column) -> Column:
    first = F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(number, F.lit("")))
    loc = F.when(F.lower(locality) != F.lower(name), F.nullif(locality, F.lit("")))
    return F.concat_ws(", ", first, loc, F.upper(country))
