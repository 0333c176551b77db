"""Queries over literal cases, whose SQL is their answers, written down by hand: scripts, numbers, tags, requests, shapes, extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelark.functions import geo, query, text
from placelark.functions.priors import poi_prior, settlement_rank
from placelark.operators import columns, extract, features, forward, index, records, render, shapes
from placelark.sources import catalog, fixtures

QUERIES, SQL = {}, {}


def _sql(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def cases(name: str, answers: list[tuple[str, str | None]]):
    """Registers f(spark) -> (item, value) with its answers, both as text."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark).select(F.col("item").cast("string").alias("item"), F.col("value").cast("string").alias("value"))
        SQL[name] = "SELECT CAST(item AS VARCHAR) AS item, CAST(value AS VARCHAR) AS value FROM (VALUES " + ", ".join(f"({_sql(a)}, {_sql(b)})" for a, b in answers) + ") t(item, value)"
        return f

    return add


def of_texts(name: str, answers: list[tuple[str, str | None]], f) -> None:
    """f(column) of each item."""
    cases(name, answers)(lambda spark: spark.createDataFrame([(a,) for a, _ in answers], "item string").select("item", f(F.col("item")).alias("value")))


_words = lambda c: F.array_join(c, " ")

# --- text -----------------------------------------------------------------------------------------------------------------
of_texts(
    "fold_scripts",
    [("Plzeň", "plzen"), ("Łódź", "lodz"), ("Đakovo", "dakovo"), ("Бања Лука", "banja luka"), ("  U  Půjčovny 2/953 ", "u pujcovny 2 953"), ("１２３", "123"), ("Ⅻ", "xii"), ("№ 5", "no 5"), ("㎡", "m2"), ("ﬁ", "fi"), ("Београд", "beograd"), ("Beograd", "beograd"), ("Львів", "lviv"), ("Мінск", "minsk"), ("Straße", "strasse"), ("東京", "東京")],
    text.fold,
)
of_texts("tokens_scripts", [("ul. Marszałkowska", "marszalkowska"), ("nám. Míru", "miru"), ("Rynek", "rynek"), ("千代田区", "千代 代田 田区"), ("日", "日"), ("서울특별시 중구", "서울특별시 중구"), ("Улица", "ulica"), ("Бања Лука", "banja luka")], lambda c: _words(text.tokens(c)))
of_texts("index_tokens_scripts", [("München", "munchen muenchen"), ("Grünstraße", "grunstrasse gruenstrasse"), ("Straße", "strasse"), ("千代田区", "千代 代田 田区"), ("Београд", "beograd"), ("Schlossstraße", "schlossstrasse schlosstrasse")], lambda c: _words(text.index_tokens(c)))


def _variants(spark: SparkSession, name: str) -> Column:
    text.register(spark)
    return F.expr(f"query_variants({name})")


@cases("spelling_variants", [("Muenchen", "muenchen munchen"), ("Neue", "neue"), ("Aue", "aue"), ("Steuerweg", "steuerweg"), ("Bauernhof", "bauernhof"), ("Museum", "museum"), ("München", "munchen muenchen")])
def _(spark):
    df = spark.createDataFrame([(x,) for x in ("Muenchen", "Neue", "Aue", "Steuerweg", "Bauernhof", "Museum", "München")], "item string")
    return df.select("item", _words(F.get(_variants(spark, "item"), 0)).alias("value"))


@cases("sql_functions", [("haversine_km", "184"), ("cell", "84513288"), ("fold", "plzen")])
def _(spark):
    text.register(spark)
    return spark.sql("SELECT 'haversine_km' AS item, cast(round(haversine_m(50.0755D, 14.4378D, 49.1951D, 16.6068D) / 1000) AS int) || '' AS value UNION ALL SELECT 'cell', cell_key(53.12D, 26.01D) || '' UNION ALL SELECT 'fold', fold('Plzeň')")


# --- numbers of houses, readings ------------------------------------------------------------------------------------------
_RUNS = [
    ("Bratislavska 334/36, 602 00 Brno", "334/36|602|00"), ("85th Street 78-52", "78-52"), ("中正南路 213號", "213號"), ("ev.223", "ev.223"), ("1963;1965", "1963;1965"), ("75 / A", "75 / A"), ("12 Main", "12"), ("205 A", "205 A"), ("20 ter", "20 ter"), ("W152S7945", "W152S7945"), ("C/18", "C/18"), ("no number", ""),
    ("5a-7b", "5a-7b"), ("12abcd", "12"), ("x 3 + 4", "3 + 4"),
]


@cases("number_runs", _RUNS)
def _(spark):
    find = F.pandas_udf(lambda s: s.map(lambda x: "|".join(query.runs(x))), "string")
    return spark.createDataFrame([(a,) for a, _ in _RUNS], "item string").select("item", find("item").alias("value"))


of_texts("first_number", [("Prazska 248/39", "248/39"), ("Via Roma 1 Torino", "1"), ("10 Downing Street", None), ("Bratislavska 22, 602 00 Brno", "22"), ("Hauptstrasse 5, 10115 Berlin", "5"), ("Praha", None)], lambda c: F.get(query.parse(c), 0)["number"])
of_texts("reading_count", [("Hauptstrasse 5, 10115 Berlin", "5"), ("Praha", "1"), ("Prazska 5", "2")], lambda c: F.size(query.parse(c)))
of_texts("orientation_number", [("248/39", "39"), ("39", None), ("12/3a", "3"), ("1/2/3", "3"), ("1/1234567890", None), ("5/ 7", None), ("a/", None)], forward.orientation_of)
of_texts("asked_number", [("ev.223", "223"), ("x", None), ("12a", "12")], forward.asked_int)
of_texts("stored_number", [("12/3", "12"), ("ev.7", "7"), ("x", "0"), ("99999999999", "0"), ("3000000000", "2147483648")], index.leading_int)

_HOUSES = [
    ("cz", "248/39", ["39"], "39 18.0"), ("cz", "248/39", ["248"], "248 6.0"), ("cz", "248/39", ["1200/39"], "1200/39 6.0"), ("cz", "248/39", ["248/39", "39"], "248/39 18.0"), ("cz", "39", ["248/39"], "248/39 18.0"), ("cz", "248", ["248/39"], "248/39 3.0"),
    ("cz", "6", ["6/2", "100/6"], "100/6 18.0"), ("de", "6", ["6/2", "100/6"], "6/2 6.0"), ("pl", "12/5", ["3/5"], "none 0.4"), ("pl", "12/5", ["12"], "12 6.0"), ("cz", "x", ["1"], "none 0.4"), ("sk", "5/7", ["7", "9/7"], "7 18.0"), ("de", "12 A", ["12a", "12 a"], "12 a 18.0"),
]


@cases("house_numbers", [(f"{c} {n} {'+'.join(s)}", a) for c, n, s, a in _HOUSES])
def _(spark):
    asked = spark.createDataFrame([(i, i, c, n, f"{c} {n} {'+'.join(s)}") for i, (c, n, s, _) in enumerate(_HOUSES)], "query_id long, anchor_id long, country string, number string, item string")
    stored = spark.createDataFrame([(100 * i + k, i, x) for i, (_, _, s, _) in enumerate(_HOUSES) for k, x in enumerate(s)], "address_id long, anchor_id long, house_number string")
    got = forward.match_house(asked.drop("item"), stored).join(stored.select("address_id", "house_number"), "address_id", "left")
    return asked.select("query_id", "item").join(got, "query_id").select("item", F.concat(F.coalesce("house_number", F.lit("none")), F.lit(" "), F.col("factor").cast("string")).alias("value"))


# --- tags -----------------------------------------------------------------------------------------------------------------
def _tagged(name: str, rows: list[tuple[dict, str | None]], f) -> None:
    answers = [(str(i), a) for i, (_, a) in enumerate(rows)]
    cases(name, answers)(lambda spark: spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(rows)], "item string, t map<string,string>").select("item", f(F.col("t")).alias("value")))


_tagged("poi_categories", [({"name": "A", "amenity": "no", "shop": "mall"}, "shop=mall"), ({"name": "B", "amenity": "bar", "disused": "yes"}, None), ({"amenity": "bar"}, None), ({"name": "x", "amenity": "bench", "tourism": "hotel"}, "tourism=hotel"), ({"name": "x", "tourism": "information"}, None), ({"name": "x", "railway": "platform", "public_transport": "station"}, "public_transport=station"), ({"name": "x", "natural": "tree"}, None), ({"name": "x", "was": "shop"}, None), ({"name": "x", "mountain_pass": "yes"}, "mountain_pass=yes")], features.poi_category)
_tagged("addressed", [({"addr:housenumber": "5"}, "true"), ({"addr:conscriptionnumber": "5"}, "true"), ({"addr:provisionalnumber": "5"}, "true"), ({"addr:housenumber": ""}, "false"), ({"name": "x"}, "false")], features.is_addressed)
_tagged("named_streets", [({"name": "a", "highway": "residential"}, "true"), ({"highway": "residential"}, "false"), ({"name": "a", "highway": "footway"}, "false"), ({"name": "a", "highway": "pedestrian"}, "true")], features.is_street)
_tagged("named_places", [({"name": "a", "place": "town"}, "true"), ({"place": "town"}, "false"), ({"name": "a", "place": "country"}, "false")], features.is_place)
_tagged("other_names", [({"name": "D", "name:en": "Dee; D", "alt_name": "Da"}, "Da|Dee"), ({"name": "D", "name:abcd": "x", "brand": "B"}, ""), ({"name": "D", "old_name": "O;;O"}, "O")], lambda t: F.array_join(features.alt_names(t), "|"))
_tagged("other_names_of_pois", [({"name": "D", "brand": "B", "operator": "A"}, "A|B")], lambda t: F.array_join(features.alt_names(t, poi=True), "|"))
_tagged("composed_numbers", [({"c": "729", "o": "37"}, "729/37"), ({"c": "729"}, "729"), ({"o": "37"}, "37"), ({"p": "9"}, "9"), ({}, None)], lambda t: records.composed_number(features.tag(t, "c"), features.tag(t, "o"), features.tag(t, "p")))
_tagged("address_anchors", [({"s": "Main", "p": "Town"}, "Main street"), ({"p": "Town"}, "Town place"), ({"s": "", "p": "Town"}, "Town place"), ({}, "none")], lambda t: F.concat_ws(" ", records.anchor_of(features.tag(t, "s"), features.tag(t, "p"))["name"], records.anchor_of(features.tag(t, "s"), features.tag(t, "p"))["kind"]))
of_texts(
    "poi_priors",
    [
        ("aeroway=aerodrome", "7.0"), ("railway=station", "5.5"), ("public_transport=station", "5.5"), ("amenity=hospital", "5.0"), ("amenity=university", "5.0"), ("natural=peak", "5.0"), ("natural=volcano", "5.0"), ("natural=glacier", "5.0"), ("natural=bay", "5.0"), ("waterway=river", "5.0"), ("natural=water", "5.0"), ("historic=castle", "4.5"), ("tourism=museum", "4.5"),
        ("tourism=zoo", "4.5"), ("tourism=theme_park", "4.5"), ("railway=halt", "4.0"), ("amenity=bus_station", "4.0"), ("amenity=townhall", "4.0"), ("amenity=college", "4.0"), ("tourism=attraction", "4.0"), ("natural=island", "3.5"), ("natural=cape", "3.5"), ("natural=spring", "3.5"), ("natural=saddle", "3.5"), ("natural=cliff", "3.5"), ("natural=cave_entrance", "3.5"), ("waterway=waterfall", "3.5"),
        ("mountain_pass=yes", "3.5"), ("natural=wood", "3.5"), ("natural=beach", "3.5"), ("amenity=theatre", "3.5"), ("amenity=library", "3.5"), ("amenity=school", "3.0"), ("railway=tram_stop", "3.0"), ("tourism=hotel", "2.5"), ("shop=mall", "2.5"), ("shop=bakery", "1.8"),
    ],
    poi_prior,
)


@cases("settlement_ranks", [("city", "7.0"), ("hamlet", "1.0"), ("borough", "3.5"), ("quarter", "2.0"), ("village", "4.0")])
def _(spark):
    df = spark.createDataFrame([("city", 1_000_000), ("hamlet", None), ("borough", 500_000), ("quarter", 0), ("village", None)], "item string, population long")
    return df.select("item", settlement_rank(F.col("item"), F.col("population")).alias("value"))


@cases("request_errors", [("0", None), ("1", None), ("2", "neither q nor a point"), ("3", "q and a point"), ("4", "limit"), ("5", "coordinates"), ("6", "country"), ("7", "radius"), ("8", "proximity"), ("9", "length of q")])
def _(spark):
    rows = [("a", None, None, 5, 100.0, "cz", "50.0,-14.5"), (None, 1.0, 2.0, 5, 100.0, None, None), (None, None, None, 5, 1.0, None, None), ("a", 1.0, 2.0, 5, 1.0, None, None), ("a", None, None, 99, 1.0, None, None), (None, 91.0, 2.0, 5, 1.0, None, None), ("a", None, None, 5, 1.0, "cze", None), ("a", None, None, 5, 60000.0, "cz", None), ("a", None, None, 5, 1.0, "cz", "50;14"), ("a" * 201, None, None, 5, 1.0, "cz", None)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "item string, q string, lat double, lon double, limit int, radius double, country string, proximity string")
    return df.select("item", render.request_error(df).alias("value"))


# --- geometry -------------------------------------------------------------------------------------------------------------
@cases("city_distances_km", [("Prague-Brno", "184"), ("Prague-Warsaw", "517")])
def _(spark):
    df = spark.createDataFrame([("Prague-Brno", 50.0755, 14.4378, 49.1951, 16.6068), ("Prague-Warsaw", 50.0755, 14.4378, 52.2297, 21.0122)], "item string, a double, b double, c double, d double")
    return df.select("item", F.round(geo.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")) / 1000).cast("int").alias("value"))


_SQUARE = [(0.0, 0.0), (0.0, 0.01), (0.01, 0.01), (0.01, 0.0)]
_ELL = [(0.0, 0.0), (0.0, 2.0), (1.0, 2.0), (1.0, 1.0), (2.0, 1.0), (2.0, 0.0)]


def _ring(spark, rows):
    return spark.createDataFrame([(i, [{"lat": a, "lon": b} for a, b in pts], *more) for i, pts, *more in rows], "item string, ring array<struct<lat:double,lon:double>>, lat double, lon double, closed boolean")


@cases("rings", [("area", "1239214"), ("diagonal", "1574"), ("inside", "true"), ("notch", "false"), ("to edge", "1113"), ("to vertex", "1245"), ("middle", "0.005 0.005"), ("ell", "0.8333 0.8333"), ("line", "0.5 0.5"), ("point", "1.0 2.0")])
def _(spark):
    df = _ring(spark, [("square", _SQUARE, 0.005, 0.02, True), ("ell", _ELL, 1.5, 1.5, True), ("line", [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)], 0.0, 0.0, False), ("point", [(1.0, 2.0)], 0.0, 0.0, False)]).cache()
    at = lambda name: df.filter(F.col("item") == name)
    put = lambda item, frame, value: frame.select(F.lit(item).alias("item"), value.cast("string").alias("value"))
    ring, lat, lon = F.col("ring"), F.col("lat"), F.col("lon")
    whole = lambda c: F.round(c).cast("int")
    p = shapes.representative_point(ring)
    spot = F.concat_ws(" ", F.round(p["lat"], 4).cast("string"), F.round(p["lon"], 4).cast("string"))
    parts = [put("area", at("square"), whole(geo.ring_area_m2(ring))), put("diagonal", at("square"), whole(extract.diagonal_m(ring))), put("inside", at("ell"), geo.contains(ring, F.lit(0.5), F.lit(0.5))), put("notch", at("ell"), geo.contains(ring, lat, lon))]
    parts += [put("to edge", at("square"), whole(geo.distance_to_shape_m(ring, F.lit(True), lat, lon))), put("to vertex", at("square"), whole(geo.distance_to_shape_m(ring, F.lit(False), lat, lon))), put("middle", at("square"), spot), put("ell", at("ell"), spot), put("line", at("line"), spot), put("point", at("point"), spot)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@cases("simplified_shapes", [("line", "2"), ("circle", "true"), ("notch", "6"), ("two", "2")])
def _(spark):
    import math

    circle = [(math.sin(i / 50) * 0.1, math.cos(i / 50) * 0.1) for i in range(314)]
    df = _ring(spark, [("line", [(0.0, i / 1000) for i in range(50)], 0.0, 0.0, False), ("circle", circle, 0.0, 0.0, False), ("notch", _ELL, 0.0, 0.0, False), ("two", _ELL[:2], 0.0, 0.0, False)])
    n = F.size(shapes.simplified(F.col("ring")))
    return df.select("item", F.when(F.col("item") == "circle", (n <= shapes.MAX_POINTS).cast("string")).otherwise(n.cast("string")).alias("value"))


@cases("stitched_rings", [("square", "5"), ("larger of two", "25.0")])
def _(spark):
    p = lambda *pts: [{"lat": float(a), "lon": float(b)} for a, b in pts]
    ways = [("square", 0, 1, 2, p((0, 0), (0, 1))), ("square", 1, 4, 3, p((1, 0), (1, 1))), ("square", 2, 2, 3, p((0, 1), (1, 1))), ("square", 3, 1, 4, p((0, 0), (1, 0))), ("open", 0, 1, 2, p((0, 0), (0, 1))), ("open", 1, 2, 3, p((0, 1), (1, 1)))]
    ways += [("larger of two", 0, 7, 7, p((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))), ("larger of two", 1, 8, 8, p((0, 0), (0, 5), (5, 5), (5, 0), (0, 0)))]
    got = shapes.stitched(spark.createDataFrame(ways, "rel_id string, seq int, first long, last long, pts array<struct<lat:double,lon:double>>"))
    top = F.array_max(F.transform("ring", lambda x: x["lat"] * x["lon"]))
    return got.select(F.col("rel_id").alias("item"), F.when(F.col("rel_id") == "square", F.size("ring").cast("string")).otherwise(top.cast("string")).alias("value"))


@cases("kept_street_shapes", [("long", "2"), ("short", None), ("one", None)])
def _(spark):
    df = _ring(spark, [("long", [(0.0, 0.0), (0.0, 0.002)], 0.0, 0.0, False), ("short", [(0.0, 0.0), (0.0, 0.0005)], 0.0, 0.0, False), ("one", [(0.0, 0.0)], 0.0, 0.0, False)])
    kept = extract.kept_street_shape(F.col("ring"))
    return df.select("item", F.when(kept.isNotNull(), F.size(kept)).alias("value"))


@cases("ring_of_cells", [("equator 0", "1"), ("equator 1", "8"), ("north 1", "14")])
def _(spark):
    df = spark.createDataFrame([("equator 0", 0.01, 0), ("equator 1", 0.01, 1), ("north 1", 59.99, 1)], "item string, lat double, ring int")
    return df.select("item", F.size(columns.ring_cells(F.col("lat"), F.lit(14.0), F.col("ring"))).alias("value"))


@cases("packed_elements", [("n 5", "20 n 5"), ("w 12", "49 w 12"), ("r 20", "82 r 20")])
def _(spark):
    df = spark.createDataFrame([("n", 5), ("w", 12), ("r", 20)], "kind string, id long").withColumn("k", columns.packed_element(F.col("kind"), F.col("id"))).withColumn("u", columns.unpacked_element(F.col("k")))
    return df.select(F.concat_ws(" ", "kind", F.col("id").cast("string")).alias("item"), F.concat_ws(" ", F.col("k").cast("string"), "u.kind", F.col("u.osm_id").cast("string")).alias("value"))


@cases("utf16_order", [("a", "0"), ("é", "1"), ("日", "2"), ("𠀀", "3"), ("ﬁ", "4")])
def _(spark):
    """Beyond the first plane before the compatibility letters, unlike code points."""
    return columns.term_ids(spark.createDataFrame([(x,) for x in ("ﬁ", "a", "𠀀", "日", "é")], "term string")).select(F.col("term").alias("item"), F.col("id").alias("value"))


@cases("fixed_shapes", [("shape", "500000000,140000000,500100000,140200000 500000000 500100000 140000000 140200000"), ("point", "500000000 500000000 140000000 140000000")])
def _(spark):
    df = spark.createDataFrame([("shape", [50.0, 14.0, 50.01, 14.02], 50.0, 14.0), ("point", [50.0, 14.0], 50.0, 14.0)], "item string, shape array<double>, lat double, lon double")
    g = columns.fixed_shape(F.col("shape"), F.col("lat"), F.col("lon"))
    box = [g[c].cast("string") for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    return df.select("item", F.concat_ws(" ", F.array_join(F.transform(g["shape"], lambda x: x.cast("string")), ","), *box).alias("value"))


# --- selections, extracts, the engine -------------------------------------------------------------------------------------
@cases("selections", [("1 cz", "czech-latest.osm.pbf"), ("2 pl", "poland-latest.osm.pbf"), ("3 lt", "https://x.example/europe/lithuania-latest.osm.pbf")])
def _(spark):
    c = spark.createDataFrame([("cz", "europe/czech", 5, "Czechia"), ("pl", "europe/poland", 9, "Poland"), ("lv", "europe/latvia", 1, "Latvia"), ("lt", "europe/lithuania", 1, "Lithuania")], catalog.COUNTRIES)
    g = spark.createDataFrame([("baltics", "lt"), ("all", "cz,pl,lt")], catalog.GROUPS)
    got = catalog.resolve("cz, PL,@baltics,@all", c, g)
    n = F.size(F.array_distinct(F.array("pos")))
    order = {"cz": "1", "pl": "2", "lt": "3"}
    return got.filter(n == 1).select(F.concat_ws(" ", F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("code")], "code").alias("item"), F.when(F.col("code") == "lt", catalog.url("https://x.example", F.col("path"))).otherwise(catalog.file_name(F.col("path"))).alias("value"))


_NODES = [
    (1, 50.0, 14.0, {}), (2, 50.0, 14.01, {}), (3, 50.01, 14.01, {}), (4, 50.01, 14.0, {}), (5, 50.02, 14.02, {"name": "Bar", "amenity": "cafe"}), (6, 50.0, 14.0, {"name": "Београд", "place": "city", "population": "1000000"}), (7, 50.001, 14.005, {"addr:housenumber": "5", "addr:street": "Main"}),
    (8, 50.0015, 14.005, {"addr:housenumber": "248/39", "addr:street": "Unmapped"}), (9, 50.4, 14.4, {"name": "千代田区", "place": "town"}), (10, 50.41, 14.41, {"addr:housenumber": "7", "addr:place": "千代田区"}), (11, 50.0001, 14.0001, {"name": "Београд", "place": "village"}), (12, 91.0, 14.0, {"name": "Gone", "amenity": "cafe"}), (13, 50.0, 14.0, {"name": "Seat", "amenity": "bench"}),
]
_WAYS = [(20, {}, [1, 2, 3]), (21, {}, [1, 4, 3]), (22, {"name": "Main", "highway": "residential"}, [1, 2, 3]), (23, {"name": "Main", "highway": "residential"}, [3, 4])]
_RELATIONS = [(30, {"name": "Park", "leisure": "park", "type": "multipolygon"}, [("way", 20, "outer"), ("way", 21, "outer")])]


def _elements(spark: SparkSession) -> DataFrame:
    """The fixture's elements, written to the shared folder as an extract and read by the source."""
    import uuid

    from placelark.operators.lineage import cut
    from placelark.sources import pbf

    cut(spark.range(1))  # a folder that all executors share is set now
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/fixture-{uuid.uuid4().hex}.osm.pbf"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(fixtures.extract(_NODES, _WAYS, _RELATIONS)))
    out.close()
    return pbf.read(spark, path)


_FEATURES = [("n5", "50.02 14.02 amenity=cafe"), ("n6", "50.0 14.0 -"), ("n7", "50.001 14.005 -"), ("n8", "50.0015 14.005 -"), ("n9", "50.4 14.4 -"), ("n10", "50.41 14.41 -"), ("n11", "50.0001 14.0001 -"), ("w22", "50.0 14.01 -"), ("w23", "50.01 14.0 -"), ("r30", "50.005 14.005 leisure=park closed")]


def _features(spark: SparkSession) -> DataFrame:
    return extract.features(_elements(spark)).withColumn("country", F.lit("cz")).withColumn("extract_size", F.lit(1))


@cases("extract_elements", [("node", "13"), ("way", "4"), ("relation", "1")])
def _(spark):
    return _elements(spark).groupBy(F.col("kind").alias("item")).agg(F.count(F.lit(1)).alias("value"))


@cases("extract_features", _FEATURES)
def _(spark):
    f = _features(spark)
    return f.select(F.concat("osm_type", F.col("osm_id").cast("string")).alias("item"), F.concat_ws(" ", F.round("lat", 4).cast("string"), F.round("lon", 4).cast("string"), F.coalesce("category", F.lit("-")), F.when(F.col("ring_closed"), "closed")).alias("value"))


@cases("places_prepass", [("node 6", "Београд"), ("node 9", "千代田区"), ("node 11", "Београд")])
def _(spark):
    e = extract.places_only(_elements(spark))
    return e.select(F.concat_ws(" ", "kind", F.col("id").cast("string")).alias("item"), F.col("tags")["name"].alias("value"))


@cases("build_counters", [("dedup_cross_extract", "10"), ("bad_coordinate", "0")])
def _(spark):
    f = _features(spark)
    return extract.build_counters(f.unionByName(f)).select(F.col("name").alias("item"), F.col("n").alias("value"))


@cases("extract_first_claim", [("n5", "large"), ("n9", "only")])
def _(spark):
    rows = spark.createDataFrame([("n", 5, "small", 1, "aa"), ("n", 5, "large", 9, "zz"), ("n", 9, "only", 1, "aa")], "osm_type string, osm_id long, who string, extract_size int, country string")
    return extract.first_claim(rows).select(F.concat("osm_type", F.col("osm_id").cast("string")).alias("item"), F.col("who").alias("value"))


@cases("name_profiles", [("all named", "3"), ("all with alias", "2"), ("all semicolons", "1"), ("tag name:<lang>", "3"), ("tag old_name", "1"), ("language en", "2"), ("language de", "1")])
def _(spark):
    rows = [({"name": "a", "name:en": "A", "name:de": "B", "old_name": "x;y"},), ({"name": "b", "name:en": "C", "name:zzzz": "D"},), ({"name": "c"},), ({"name:en": "unnamed"},)]
    return extract.name_profile(spark.createDataFrame(rows, "tags map<string,string>")).select(F.concat_ws(" ", "section", "key").alias("item"), F.col("n").alias("value"))


@cases("relation_profile", [("total", "1"), ("named", "1"), ("poi", "1"), ("addressed", "0")])
def _(spark):
    one = extract.relation_profile(_elements(spark))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in one.columns])).alias("x")).select("x.*")


_stored: dict[str, str] = {}


def _path(spark: SparkSession) -> str:
    """The fixture's tables and index, stored in the shared folder once an application."""
    from placelark.operators.lineage import cut
    from placelark.plans import indexing
    from placelark.plans.geocoder import Geocoder

    app = spark.sparkContext.applicationId
    if app not in _stored:
        t = indexing.from_features(cut(_features(spark)))
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/fixture-{app}"
        for name, df in t.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        t = {name: spark.read.parquet(f"{path}/{name}") for name in t}
        Geocoder.build(t["anchors"], t["addresses"], t["shapes"]).write(f"{path}/index")
        _stored[app] = path
    return _stored[app]


def _tables(spark: SparkSession) -> dict[str, DataFrame]:
    path = _path(spark)
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("anchors", "addresses", "shapes", "counters")}


def _geocoder(spark: SparkSession):
    from placelark.plans.geocoder import Geocoder

    return Geocoder.load(spark, f"{_path(spark)}/index")


@cases("records_to_anchors", [("0 Main", "Београд 1.0"), ("0 Unmapped", "Београд 1.0"), ("1 Београд", "Београд 12.0"), ("1 千代田区", "千代田区 3.5"), ("2 Bar", "Београд 1.8"), ("2 Park", "Београд 3.0")])
def _(spark):
    return _tables(spark)["anchors"].select(F.concat_ws(" ", F.col("layer").cast("string"), "name").alias("item"), F.concat_ws(" ", "locality", F.round("prior", 6).cast("string")).alias("value"))


@cases("records_to_addresses", [("5", "Main"), ("248/39", "Unmapped"), ("7", "千代田区")])
def _(spark):
    t = _tables(spark)
    return t["addresses"].join(t["anchors"], "anchor_id").select(F.col("house_number").alias("item"), F.col("name").alias("value"))


@cases("index_counters", [("anchor_street", "1"), ("anchor_place", "2"), ("anchor_poi", "2"), ("address_no_anchor", "0"), ("address_bound_to_place", "1"), ("anchor_synthetic_place", "0"), ("anchor_synthetic_street", "1"), ("anchor_duplicate_key", "0")])
def _(spark):
    return _tables(spark)["counters"].select(F.col("name").alias("item"), F.col("n").alias("value"))


_ASKED = [("Main 5", "Main 5"), ("Београд", "Београд -"), ("Beograd", "Београд -"), ("千代田区 7", "千代田区 7"), ("千代田", "千代田区 -"), ("Unmapped 39", "Unmapped 248/39"), ("Beogrd", "Београд -"), ("nothing", None)]


@cases("geocode_scripts", _ASKED)
def _(spark):
    """The extract, through records and index, to the engine's first answers."""
    g = _geocoder(spark)
    q = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_ASKED)], "query_id long, q string")
    best = g.forward(q).filter("rank = 1").select("query_id", F.concat_ws(" ", "name", F.coalesce("house_number", F.lit("-"))).alias("value"))
    return q.join(best, "query_id", "left").select(F.col("q").alias("item"), "value")


@cases("responses", [("1", "200 Main"), ("2", "400"), ("3", "400"), ("4", "200 Park"), ("5", "200 hint"), ("6", "200 none")])
def _(spark):
    g = _geocoder(spark)
    rows = [(1, "Main 5", None, None, 1, None, "cz", None), (2, None, None, None, None, None, None, None), (3, "Main", None, None, None, None, "pl", None), (4, None, 50.001, 14.0051, 1, 100.0, None, None), (5, None, 14.005, 50.001, None, 100.0, None, None), (6, "zzzzz", None, None, None, None, None, None)]
    got = render.respond(spark.createDataFrame(rows, "request_id long, q string, lat double, lon double, limit int, radius double, country string, proximity string"), g)
    name = F.regexp_extract("json", '"name":"([^"]*)"', 1)
    return got.select(F.col("request_id").alias("item"), F.when(F.col("status") == 400, "400").otherwise(F.concat(F.lit("200 "), F.when(name != "", name).when(F.contains("json", F.lit("hint")), "hint").otherwise("none"))).alias("value"))
