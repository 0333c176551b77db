"""Work that must not grow with copies: what the operators are asked, on tables with many rows alike; answers by SQL or by brute force."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from placelark.operators import forward, index, reverse
from placelark.plans import catalogue, geocoder


@pytest.fixture(scope="module")
def alike(tmp_path_factory):
    """30 places asked by 40 customers each, 60 parts, texts of a few names, orders."""
    d = str(tmp_path_factory.mktemp("alike"))
    c = duckdb.connect()
    c.execute("create table customer as select 10000 * (i % 40) + i // 40 as c_custkey from range(1200) r(i)")
    c.execute("create table part as select i as p_partkey, cast(20 + i % 31 as integer) as p_size from range(60) r(i)")
    c.execute("create table orders as select i as o_orderkey, i // 3 as o_custkey from range(300) r(i)")
    names = "['Ouwhea the red hill', 'The and of in', 'Rue Verte Paris sud', 'Ouwhea hill the of', 'the', '', 'Nord the Ouwhea Paris']"
    c.execute(f"create table documents as select i as doc_id, {names}[1 + i % 7] || CASE WHEN i % 5 = 0 THEN ' more' ELSE '' END as text, ['de', 'en', 'fr'][1 + i % 3] as lang, i * 10 as n_chars from range(140) r(i)")
    for t in ("customer", "part", "orders", "documents"):
        c.execute(f"copy {t} to '{d}/{t}.parquet'")
    return d, c


def same_as_sql(spark, alike, name):
    d, c = alike
    df = catalogue.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    assert got and got == sorted(map(repr, c.sql(catalogue.SQL[name]).select(*cols).fetchall()))


def asked(monkeypatch, module, name):
    """The rows that the function's first argument has, by call."""
    seen, f = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda first, *a, **b: (seen.append(first.count()), f(first, *a, **b))[1])
    return seen


@pytest.mark.parametrize("name", ["point_in_polygon", "containing_regions_top3", "reverse_two_tier"])
def test_a_place_is_searched_once(spark, alike, monkeypatch, name):
    seen = asked(monkeypatch, reverse, "containing")
    same_as_sql(spark, alike, name)
    assert seen == [30]


@pytest.mark.parametrize("name", ["point_in_polygon", "containing_regions_top3"])
def test_neither_points_nor_shapes_pass_the_driver(spark, alike, name):
    """However small their files: Spark takes a table's size from those. The plan that ran, under Spark's own threshold for broadcasts."""
    same_as_sql(spark, alike, name)
    df = catalogue.QUERIES[name](spark, alike[0])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_engine_searches_a_place_once(spark, alike, monkeypatch):
    seen = asked(monkeypatch, reverse, "containing")
    d, c = alike
    got = catalogue.QUERIES["geocode_reverse"](spark, d)
    assert seen == [30] and got.select("point_id").distinct().count() == 1200


def test_rings_within_a_points_own_radius(spark):
    at = lambda lat, lon: f"named_struct('lat', {lat}D, 'lon', {lon}D)"
    square = lambda i, lat: f"SELECT {i}L AS shape_id, true AS closed, array({at(lat, 9)}, {at(lat, 9.2)}, {at(lat + 0.2, 9.2)}, {at(lat + 0.2, 9)}) AS ring, {lat}D AS min_lat, 9D AS min_lon, {lat + 0.2}D AS max_lat, 9.2D AS max_lon"
    s = spark.sql(f"{square(1, 47)} UNION ALL {square(2, 47.21)}")
    p = spark.sql("SELECT 1L AS point_id, 47.195D AS lat, 9.1D AS lon, 1000D AS within UNION ALL SELECT 2L, 47.195D, 9.1D, 5000D UNION ALL SELECT 3L, 47.1D, 9.21D, 1e9D")
    got = sorted((r.point_id, r.feature_id, round(r.distance_m)) for r in geocoder.ring_distances(p, s, 3000.0).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (2, 2, 1670), (3, 1, 758)]


def test_nearest_of_many_places(spark, monkeypatch):
    """All of one name, in clusters and far from them; brute force."""
    lat, lon = "47 + pmod(id * 7919, 10000) / 10000D", "9 + pmod(id * 4729, 10000) / 10000D"
    p = spark.range(600).selectExpr("'de' AS country", "'Ort' AS name", "id AS anchor_id", f"CASE WHEN id < 300 THEN 47 + ({lat} - 47) / 50 ELSE {lat} END AS lat", f"CASE WHEN id < 300 THEN 9 + ({lon} - 9) / 50 ELSE {lon} END AS lon")
    a = spark.range(1000, 1400).selectExpr("id AS address_id", "'de' AS country", "'Ort' AS place", f"CASE WHEN id % 50 = 0 THEN 44D ELSE {lat} END AS lat", f"{lon} AS lon")
    met = index.bind_places(a, p)
    dx, dy = (F.col("p.lon") - F.col("a.lon")) * F.cos(F.radians("a.lat")), F.col("p.lat") - F.col("a.lat")
    want = a.alias("a").join(p.alias("p")).groupBy("address_id").agg(F.min(F.struct(dx * dx + dy * dy, "anchor_id"))["anchor_id"].alias("anchor_id"))
    assert sorted(met.collect()) == sorted(want.collect()) and met.count() == 400
    seen = asked(monkeypatch, index, "cut")
    index.bind_places(a, p)
    assert sum(seen[3:]) == 392  # settled on the grid: all but those far from every place


def test_queries_of_a_name_are_searched_once(spark, alike, monkeypatch):
    seen = asked(monkeypatch, forward, "candidates")  # its words are counted
    for name in ("candidates_and", "cheap_score", "cheap_topk", "forward_country", "forward_proximity", "forward_topk", "forward_dedup"):
        same_as_sql(spark, alike, name)
    assert catalogue.QUERIES["geojson_collection"](spark, alike[0]).count() == 124 and catalogue.QUERIES["score_bound"](spark, alike[0]).first()[0] == 0
    assert all(n <= 14 for n in seen) and len(seen) == 9  # words of the eight different names


def test_expand_deals_a_name_out(spark):
    m = spark.range(500).selectExpr("0L AS query_id", "id AS member")
    got = forward.expand(spark.createDataFrame([(7, 0), (8, 0)], "anchor_id long, query_id long"), m, size=10)
    assert got.columns == ["anchor_id", "query_id"] and sorted(map(tuple, got.collect())) == sorted((a, q) for a in (7, 8) for q in range(500))


def test_engine_answers_alike_queries_once(spark, alike, monkeypatch):
    """140 queries of a few words: what is searched and ranked are those, and each query has the answers of its word."""
    seen = asked(monkeypatch, forward, "expand")
    d, c = alike
    got = catalogue.QUERIES["geocode_corrected"](spark, d).collect()
    assert len(seen) == 1 and 8 <= seen[0] <= 24
    word = dict(c.sql("select doc_id, regexp_extract(text, '\\p{L}+') from documents").fetchall())
    by_word = {}
    for r in got:
        by_word.setdefault(word[r.query_id], {}).setdefault(r.query_id, []).append((r["rank"], r.anchor_id, r.score, r.corrected))
    asking = {w: sum(x == w for x in word.values()) for w in by_word}
    assert all(len(q) == asking[w] and len({tuple(sorted(x)) for x in q.values()}) == 1 for w, q in by_word.items())
    assert {w: {x[3] for q in of.values() for x in q} for w, of in by_word.items()} == {"Ouwhea": {"ouwhea"}, "The": {None}, "the": {None}, "Rue": {None}, "more": {None}}


def test_text_candidates_by_every_pair(spark):
    """Against all pairs of a text and an anchor: repeated words, several forms, a prefix that starts another, rarest words first and last."""
    own = [["a", "ab", "abc"], ["ab", "x"], ["x", "a"], ["x", "y", "ab"], ["y"], ["ss", "x"], ["sss", "y", "x"], ["x", "xa"]] + [["x"]] * 3
    a = spark.createDataFrame([(i, w, [w[:1]], w[1:]) for i, w in enumerate(own)], "anchor_id long, own array<string>, names array<array<string>>, loc_tokens array<string>")
    df = {t: sum(t in w for w in own) for w in own for t in w}
    variants = [[["a"]], [["x"], ["a"]], [["x"], ["x"]], [["x", "y"], ["ab"]], [["sss", "ss"]], [["abc"], ["a"]], [["q"], ["a"]], [["x"], ["q"]], [["x"], [""]], [["y"], ["x"], ["a", "ab"]]]
    texts = spark.createDataFrame([(i, [f[0] for f in v], v) for i, v in enumerate(variants)], "text long, tokens array<string>, variants array<array<string>>")
    terms = spark.createDataFrame(list(df.items()), "term string, df long")
    got = {(r.text, r.anchor_id): round(r.text_weight, 9) for r in forward.text_candidates(texts, a, terms, a.selectExpr("count(*) AS n")).collect()}
    idf = lambda ts: math.log(1 + len(own) / (500 + sum(df[t] for t in ts)))
    want = {}
    for i, v in enumerate(variants):
        starts = {t for t in df if any(p and t.startswith(p) for p in v[-1])}
        for j, w in enumerate(own):
            if all(set(f) & set(w) for f in v[:-1]) and starts & set(w):
                heads = [idf(set(f) & set(df)) if [x[0] for x in v].index(f[0]) == k else 0.0 for k, f in enumerate(v[:-1])]
                want[i, j] = round(sum(heads) + max(idf(starts) * (len(p) / len(t)) ** 2 for p in v[-1] if p for t in starts & set(w) if t.startswith(p)), 9)
    assert len(want) > 20 and got == want


def test_top_houses_by_match_house(spark, monkeypatch):
    """Against all pairs: composed numbers, ties, groups with and without numbers, scores of 0; only pairs with a common number are made."""
    numbers = ["5", "12/5", "5/12", "ev.5", "", "x", "0", "12", "5a", "7/"]
    a = spark.createDataFrame([(100 * k + i, k, numbers[(k * 3 + i) % 10]) for k in range(40) for i in range(k % 5)], "address_id long, anchor_id long, house_number string")
    scored = spark.createDataFrame([(g, k, "cz" if k % 2 else None if k % 3 else "de", float((k * 7 + g) % 9)) for g in range(4) for k in range(40) if k % (g + 1) == 0], "group long, anchor_id long, country string, score double")
    asked = spark.createDataFrame([(10 * g + i, g, n) for g in range(4) for i, n in enumerate([None, "5", "5a", "12/5", "5/", "0", "99", "٣"])], "query_id long, group long, number string")
    pairs = asked.join(scored, "group")
    got = forward.match_house(pairs.filter("number IS NOT NULL").select("query_id", "anchor_id", "country", "number"), a)
    want = forward.top(pairs.join(got, ["query_id", "anchor_id"], "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))), 5)
    columns = ["query_id", "rank", "anchor_id", "address_id", "score"]
    rows = lambda df: sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    assert rows(forward.top_houses(asked, scored, a, 5)) == rows(want) and want.count() == 160


def test_engine_makes_no_pairs_of_numbers_and_anchors(spark, alike, monkeypatch):
    """Forty queries of a name that twenty anchors have, by number: most anchors have none of the numbers."""
    seen = asked(monkeypatch, forward, "match_house")
    made = asked(monkeypatch, forward, "cut")
    d, c = alike
    assert catalogue.QUERIES["geocode_forward"](spark, d).select("query_id").distinct().count() > 100
    assert not seen and made[-1] < 140


def test_variants_meet_anchors_once(spark, alike, monkeypatch):
    """Pairs are not gathered to be told apart."""
    seen = asked(monkeypatch, forward, "candidates")
    same_as_sql(spark, alike, "candidates_variant_or")
    assert not seen


@pytest.mark.parametrize("size", [2, 1000])
def test_any_of_by_every_pair(spark, size):
    own = [["a", "b"], ["a"], ["b", "c"], ["a", "b", "c", "d"], [], ["d"], ["a", "c"]] * 3
    forms = [["a"], ["a", "b"], ["b", "a", "b"], ["c", "d"], ["q"], [], ["q", "c", "a"], ["a", "b", "c", "d"]] * 2
    a = spark.createDataFrame(list(enumerate(own)), "anchor_id long, own array<string>")
    q = spark.createDataFrame(list(enumerate(forms)), "query_id long, forms array<string>")
    want = sorted((i, j) for i, f in enumerate(forms) for j, w in enumerate(own) if set(f) & set(w))
    assert sorted(map(tuple, forward.any_of(q, a, size).collect())) == want
