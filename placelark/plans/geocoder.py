"""The engine over an index: build its tables, store and load them, answer batches of queries and of points.

Tables: anchors (anchor_id, layer 0 street / 1 place / 2 poi, country, name, locality, alt_names, category, prior, lat, lon; names and
loc_tokens, the tokens of each name, canonical first, and of the locality, and own, the terms of all its postings, are added),
addresses (address_id, anchor_id, house_number, sort_key, lat, lon), shapes (shape_id = anchor_id, closed, ring, box), and
from these postings (term, anchor_id), terms (term, df) and coverage (country, box).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelark.functions import geo
from placelark.functions.query import parse
from placelark.functions.text import fold, index_tokens, index_tokens_each, tokens, tokens_each
from placelark.operators import features, forward, index, reverse
from placelark.operators.lineage import cut

# Fixed values.
VERSION, LIMIT, REVERSE_LIMIT, MOST, RADIUS, MOST_RADIUS = 2, 10, 5, 50, 5000.0, 50000.0
TABLES = ["anchors", "addresses", "shapes", "postings", "terms", "coverage"]
_NO_SHAPES = "shape_id long, closed boolean, ring array<struct<lat:double,lon:double>>, min_lat double, max_lat double, min_lon double, max_lon double"


def filter_locally(results: DataFrame, text: Column) -> DataFrame:
    """Results whose rendered name holds the text, both folded; an empty text keeps all."""
    return results.filter(F.contains(fold(F.col("place_name")), fold(F.coalesce(text, F.lit("")))))


def within_coverage(points: DataFrame, coverage: DataFrame, radius: float) -> DataFrame:
    """Points without a country, and those inside their country's box padded by the radius; an unknown country drops its."""
    pad = radius / geo.METRES_PER_DEGREE
    c = coverage.select(F.col("country").alias("_c"), *[F.col(x).alias(f"_{x}") for x in ("min_lat", "max_lat", "min_lon", "max_lon")])
    wide = pad / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    inside = F.col("lat").between(F.col("_min_lat") - pad, F.col("_max_lat") + pad) & F.col("lon").between(F.col("_min_lon") - wide, F.col("_max_lon") + wide)
    return points.join(c, F.lower("country") == F.col("_c"), "left").filter(F.col("country").isNull() | F.coalesce(inside, F.lit(False))).select(*points.columns)


def ring_distances(points: DataFrame, shapes: DataFrame, radius: float) -> DataFrame:
    """(point_id, feature_id, distance_m) of shapes within the radius, 0 inside; points may have a smaller radius of their own, `within`.
    The cells of the shapes' boxes meet those within a point's radius in an equi-join; a pair counts in the first cell that both have. Boxes go before rings."""
    span = lambda n, lo, hi: {f"{n}0": F.floor(lo / geo.CELL), f"{n}1": F.floor(hi / geo.CELL)}
    each = lambda df, y, x: df.withColumn("cy", F.explode(F.sequence(f"{y}0", f"{y}1"))).withColumn("cx", F.explode(F.sequence(f"{x}0", f"{x}1")))
    box = ("min_lat", "min_lon", "max_lat", "max_lon")
    s = shapes.select(F.col("shape_id").alias("feature_id"), "closed", "ring", *box).withColumns(span("sy", F.col("min_lat"), F.col("max_lat")) | span("sx", F.col("min_lon"), F.col("max_lon")))
    within = F.least(F.col("within"), F.lit(radius)) if "within" in points.columns else F.lit(radius)
    p = points.select("point_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"), within.alias("within"))
    pad = (F.col("within") * 1.0001 + 0.01) / geo.METRES_PER_DEGREE
    wide = pad / F.greatest(F.cos(F.radians("plat")), F.lit(0.01))
    p = p.withColumns(span("py", F.col("plat") - pad, F.col("plat") + pad) | span("px", F.col("plon") - wide, F.col("plon") + wide))
    at = (F.col("plat"), F.col("plon"))
    first = (F.col("cy") == F.greatest("sy0", "py0")) & (F.col("cx") == F.greatest("sx0", "px0"))
    near = geo.bbox_distance_m(*at, *map(F.col, box)) <= F.col("within") * 1.0001 + 0.01
    d = F.when(F.col("closed") & geo.contains(F.col("ring"), *at), 0.0).otherwise(geo.distance_to_shape_m(F.col("ring"), F.col("closed"), *at))
    pairs = each(p, "py", "px").join(each(s, "sy", "sx"), ["cy", "cx"]).filter(first & near)
    return pairs.withColumn("distance_m", d).filter(F.col("distance_m") <= F.col("within")).select("point_id", "feature_id", "distance_m")


class Geocoder:
    def __init__(self, tables: dict[str, DataFrame]):
        self.t = tables

    # --- index --------------------------------------------------------------------------------------------------------
    @classmethod
    def build(cls, anchors: DataFrame, addresses: DataFrame, shapes: DataFrame | None = None) -> Geocoder:
        spark = anchors.sparkSession
        text = lambda c: F.coalesce(c, F.lit(""))
        own = F.array_distinct(F.concat(index_tokens(text("name")), index_tokens(text("locality")), F.flatten(index_tokens_each(F.col("alt_names")))))
        names = F.concat(F.array(tokens(text("name"))), tokens_each(F.col("alt_names")))
        anchors = anchors.withColumn("names", names).withColumn("loc_tokens", tokens(text("locality"))).withColumn("own", own)
        spots = anchors.select("country", "lat", "lon").unionByName(addresses.join(anchors.select("anchor_id", "country"), "anchor_id").select("country", "lat", "lon"))
        posts = cls._postings(anchors)
        a = addresses.withColumn("sort_key", index.leading_int(F.col("house_number")))
        return cls({"anchors": anchors, "addresses": a, "shapes": shapes if shapes is not None else spark.createDataFrame([], _NO_SHAPES), "postings": posts, "terms": index.term_df(posts), "coverage": index.coverage(spots)})

    @staticmethod
    def _postings(anchors: DataFrame) -> DataFrame:
        return anchors.select(F.explode("own").alias("term"), "anchor_id")

    def cached(self) -> Geocoder:
        """The same over tables that executors hold, on disk where memory is short; for an index of one session."""
        return Geocoder({k: v.persist() for k, v in self.t.items()})

    def write(self, path: str) -> None:
        """The tables under path, each clustered by what queries join it on, and a manifest of their version and rows.
        Postings and terms are made of the stored tables: names are read into tokens once."""
        order = {"postings": ["term", "anchor_id"], "addresses": ["anchor_id", "sort_key", "house_number"], "anchors": ["anchor_id"], "terms": ["term"]}
        spark = self.t["anchors"].sparkSession
        stored = lambda name: spark.read.parquet(f"{path}/{name}")
        made = {"postings": lambda: self._postings(stored("anchors")), "terms": lambda: index.term_df(stored("postings"))}
        for name in TABLES:
            df, by = made[name]() if name in made else self.t[name], order.get(name)
            (df.repartition(by[0]).sortWithinPartitions(*by) if by else df).write.parquet(f"{path}/{name}")
        rows = [(name, VERSION, stored(name).count()) for name in TABLES]
        spark.createDataFrame(rows, "name string, version int, n long").coalesce(1).write.json(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Geocoder:
        """The stored index. Another version, a missing table or another number of rows raises."""
        manifest = {r["name"]: r for r in spark.read.json(f"{path}/manifest", schema="name string, version int, n long").collect()}  # a row a table
        if set(manifest) != set(TABLES) or any(r["version"] != VERSION for r in manifest.values()):
            raise ValueError(f"not an index of version {VERSION}: {path}")
        t = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
        short = [name for name, df in t.items() if df.count() != manifest[name]["n"]]
        if short:
            raise ValueError(f"rows missing or extra: {', '.join(short)}")
        return cls(t)

    # --- forward ------------------------------------------------------------------------------------------------------
    def _search(self, texts: DataFrame) -> DataFrame:
        """texts (text, tokens, variants) to anchors (text, anchor_id, country, lat, lon, cheap, fit): each text is searched once, whoever asks it."""
        anchors, terms = self.t["anchors"], self.t["terms"]
        n_anchors = anchors.agg(F.count(F.lit(1)).alias("n"))
        best = anchors.filter("layer = 1").groupBy(F.col("name").alias("locality")).agg(F.max("prior").alias("locality_best"))
        boost = F.when(F.col("layer") == 1, 1.25).when(F.col("layer") == 0, 1 + F.coalesce("locality_best", F.lit(0.0)) / 10).otherwise(1.0)
        known = anchors.join(best, "locality", "left").select("anchor_id", "country", "lat", "lon", "prior", boost.alias("boost"), "own", "names", "loc_tokens")
        found = forward.text_candidates(texts, known, terms, n_anchors)
        return cut(found.select("text", "anchor_id", "country", "lat", "lon", (F.col("text_weight") * F.col("prior") * F.col("boost")).alias("cheap"), "fit"))

    @staticmethod
    def _first(asked: DataFrame, found: DataFrame) -> DataFrame:
        """asked (ask, reading, text, number, want) to the first reading of each that finds an anchor of its country."""
        alive = found.groupBy("text").agg(F.collect_set("country").alias("countries"))
        some = asked.join(alive, "text").filter(F.col("want").isNull() | F.array_contains("countries", F.col("want")))
        return some.groupBy("ask").agg(F.min(F.struct("reading", "text", "number")).alias("r")).select("ask", "r.text", "r.number")

    def _corrected(self, texts: DataFrame) -> DataFrame:
        """texts (text, tokens) that have unknown words with a correction, with these in place: (text, tokens)."""
        word = texts.select("text", F.posexplode("tokens").alias("pos", "word"))
        fixed = forward.best_correction(forward.corrections(word.select("word").distinct(), self.t["terms"])).withColumnRenamed("term", "fix")
        again = word.join(fixed, "word", "left").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fix", "word").alias("t")))).alias("p"), F.max(F.col("fix").isNotNull()).alias("changed")).filter("changed")
        return again.select("text", F.transform("p", lambda x: x["t"]).alias("tokens"))

    def _ranked(self, chosen: DataFrame, found: DataFrame, proximity: bool, most: int) -> DataFrame:
        """chosen (ask, text, number, want, at_lat, at_lon, corrected) to their best anchors, with the address of the number that was asked for.
        Those that differ in their number alone are scored as one group."""
        near = F.when(F.col("at_lat").isNotNull() & F.col("at_lon").isNotNull(), forward.proximity(F.col("at_lat"), F.col("at_lon"), F.col("lat"), F.col("lon"))).otherwise(1.0) if proximity else F.lit(1.0)
        place = F.struct("text", "want", "at_lat", "at_lon")
        chosen = cut(chosen.withColumn("place", place))
        groups = cut(chosen.select("place").distinct().withColumn("group", F.monotonically_increasing_id()))
        scored = groups.select("group", "place.*").join(found, "text").filter(F.col("want").isNull() | (F.col("want") == F.col("country")))
        scored = scored.select("group", "anchor_id", "country", (F.col("cheap") * near * F.col("fit")).alias("score"))
        asked = chosen.join(groups, "place").select(F.col("ask").alias("query_id"), "group", "number")
        best = forward.top_houses(asked, scored, self.t["addresses"], most)
        return self._shown(best.join(chosen.select(F.col("ask").alias("query_id"), "corrected"), "query_id"))

    def _shown(self, best: DataFrame) -> DataFrame:
        """Ranked rows with the columns of their anchors and addresses, and the name that duplicates agree in."""
        at = self.t["addresses"].select("address_id", "house_number", F.col("lat").alias("hlat"), F.col("lon").alias("hlon"))
        rows = best.select("query_id", "anchor_id", "address_id", "rank", "score", "corrected").join(self.t["anchors"], "anchor_id").join(at, "address_id", "left")
        rows = rows.withColumn("lat", F.coalesce("hlat", "lat")).withColumn("lon", F.coalesce("hlon", "lon")).withColumn("k", fold(F.col("name")))
        return cut(rows.select("query_id", "anchor_id", "address_id", "rank", "score", "corrected", "layer", "name", "k", "house_number", "locality", "country", "category", "lat", "lon"))

    def forward(self, queries: DataFrame, limit: int = LIMIT, fuzzy: bool = True) -> DataFrame:
        """queries (query_id, q; country, lat, lon if there) to (query_id, rank, anchor_id, address_id, ..., score, corrected).

        Readings are tried in order, after the country filter. Queries that nothing matches are tried once more with
        their unknown words corrected; `corrected` is then the text that was searched. Every candidate is scored.
        Queries that ask the same are answered once, and texts that several of them read are searched once.
        """
        limit = max(1, min(MOST, limit))
        has = set(queries.columns)
        opt = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind)
        queries = queries.select("query_id", F.struct(F.col("q"), F.lower(opt("country", "string")).alias("want"), opt("lat", "double").alias("at_lat"), opt("lon", "double").alias("at_lon")).alias("what"))
        asks = cut(queries.select("what").distinct().withColumn("ask", F.monotonically_increasing_id()))  # a number must not change
        members = queries.join(asks, "what").select(F.col("ask").alias("query_id"), F.col("query_id").alias("member"))
        read = cut(asks.select("ask", F.col("what.want").alias("want"), F.posexplode(parse(F.col("what.q"))).alias("reading", "r")).select("ask", "want", "reading", "r.tokens", "r.variants", "r.number"))  # texts are parsed once
        texts = cut(read.select("tokens", "variants").distinct().withColumn("text", F.monotonically_increasing_id()))
        read = read.join(texts, ["tokens", "variants"]).select("ask", "reading", "text", "number", "want")
        found = self._search(texts)
        chosen = self._first(read, found).withColumn("corrected", F.lit(None).cast("string"))
        if fuzzy:
            chosen = cut(chosen)
            left = cut(read.join(chosen.select("ask"), "ask", "left_anti"))
            fixed = cut(self._corrected(left.select("text").distinct().join(texts, "text").select("text", "tokens")))
            again = cut(fixed.select("tokens").distinct().withColumn("text", -1 - F.monotonically_increasing_id()).withColumn("variants", F.transform("tokens", lambda t: F.array(t))))
            other = fixed.join(again.select("tokens", F.col("text").alias("other")), "tokens").select("text", "other")
            redone = self._search(again)
            redo = left.join(other, "text").drop("text").withColumnRenamed("other", "text")
            chosen = chosen.unionByName(self._first(redo, redone).join(again.select("text", F.array_join("tokens", " ").alias("corrected")), "text"))
            found = found.unionByName(redone)
        chosen = chosen.join(asks.select("ask", "what.want", "what.at_lat", "what.at_lon"), "ask")
        ranked = self._ranked(chosen, found, {"lat", "lon"} <= has, limit + forward.HEADROOM)
        kept = forward.drop_near(ranked.withColumnRenamed("house_number", "number"), limit).select("query_id", F.col("rank").alias("place"), "anchor_id")
        out = ranked.join(kept, ["query_id", "anchor_id"]).withColumn("place_name", features.place_name(F.col("name"), F.col("house_number"), F.col("locality"), F.col("country")))
        out = out.select("query_id", F.col("place").alias("rank"), "anchor_id", "address_id", "layer", "name", "house_number", "locality", "country", "category", "lat", "lon", "score", "corrected", "place_name")
        return forward.expand(out, members)

    # --- reverse ------------------------------------------------------------------------------------------------------
    def reverse(self, points: DataFrame, limit: int = REVERSE_LIMIT, radius: float = RADIUS) -> DataFrame:
        """points (point_id, lat, lon; country if there) to (point_id, rank, tier, anchor_id, address_id, distance_m, score).

        Tier 1: the three smallest regions that contain the point. Tier 2: what is nearest within the radius, addresses
        and anchors alike; other containing regions are at distance 0. Points at one place are searched once.
        """
        limit, radius = max(1, min(MOST, limit)), max(1.0, min(MOST_RADIUS, radius))
        on = [c for c in ("lat", "lon", "country") if c in points.columns]
        return reverse.once_each(points, lambda spots: self._reverse(spots, limit, radius), tuple(on))

    def _reverse(self, points: DataFrame, limit: int, radius: float) -> DataFrame:
        anchors, addresses, shapes = self.t["anchors"], self.t["addresses"], self.t["shapes"]
        by_country = "country" in points.columns
        if by_country:
            points = within_coverage(points, self.t["coverage"], radius)
        p = points.select("point_id", "lat", "lon")
        inside = reverse.containing(p, shapes)
        spots = addresses.select(F.struct(F.lit(0).alias("kind"), F.col("address_id").alias("id")).alias("feature_id"), "anchor_id", "lat", "lon")
        lone = anchors.join(shapes.select(F.col("shape_id").alias("anchor_id")), "anchor_id", "left_anti")
        spots = spots.unionByName(lone.select(F.struct(F.lit(1).alias("kind"), F.col("anchor_id").alias("id")).alias("feature_id"), "anchor_id", "lat", "lon"))
        rings = lambda p: ring_distances(p, shapes, radius).select("point_id", F.col("feature_id").alias("anchor_id"), F.lit(None).cast("long").alias("address_id"), "distance_m")
        if by_country:  # the country filters before the limit
            want = points.select("point_id", F.lower("country").alias("want"))
            of = anchors.select("anchor_id", "country")
            mine = lambda df: df.join(want, "point_id").join(of, "anchor_id").filter("want IS NULL OR want = country").drop("want", "country")
            inside = mine(inside.withColumnRenamed("shape_id", "anchor_id")).withColumnRenamed("anchor_id", "shape_id")
            listed = points.select("point_id", "lat", "lon", F.lower("country").alias("country"))
            got = reverse.nearest(listed.filter("country IS NOT NULL"), spots.join(of, "anchor_id"), limit, radius, on=("country",))
            got = got.unionByName(reverse.nearest(listed.filter("country IS NULL"), spots, limit, radius))
        else:
            got = reverse.nearest(p, spots, limit, radius)
        got = cut(got)  # read for its distances and its rows
        # a shape farther than a point's last hit, where there are `limit`, can't come before those
        enough = got.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance_m").alias("within")).filter(F.col("n") >= limit).select("point_id", "within")
        rings = rings(p.join(enough, "point_id", "left").withColumn("within", F.coalesce("within", F.lit(radius))))
        rings = mine(rings) if by_country else rings
        head = reverse.top_containing(inside).select("point_id", F.col("shape_id").alias("anchor_id"), F.lit(None).cast("long").alias("address_id"), F.lit(1).alias("tier"), F.lit(0.0).alias("distance_m"), (1000 / (1 + F.col("area_m2") / 1e4)).alias("score"))
        near = got.join(spots.select("feature_id", "anchor_id"), "feature_id").select("point_id", "anchor_id", F.when(F.col("feature_id.kind") == 0, F.col("feature_id.id")).alias("address_id"), "distance_m")
        near = near.unionByName(rings.join(head.select("point_id", "anchor_id"), ["point_id", "anchor_id"], "left_anti").select(near.columns))
        near = near.select("*", F.lit(2).alias("tier"), (1 / (1 + F.col("distance_m"))).alias("score"))
        w = Window.partitionBy("point_id").orderBy("tier", F.when(F.col("tier") == 1, -F.col("score")).otherwise(F.col("distance_m")), F.col("address_id").asc_nulls_last(), "anchor_id")
        out = head.unionByName(near).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
        return out.select("point_id", "rank", "tier", "anchor_id", "address_id", F.round("distance_m", 1).alias("distance_m"), "score")
