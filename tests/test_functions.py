"""Literals and properties of the scalar functions, and brute force for the spatial ones."""

import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placelark.functions import geo, text
from placelark.operators import features, forward, index, reverse

FOLDS = {"Plzeň": "plzen", "Łódź": "lodz", "Đakovo": "dakovo", "Бања Лука": "banja luka", "  U  Půjčovny 2/953 ": "u pujcovny 2 953", "１２３": "123", "Ⅻ": "xii", "№ 5": "no 5", "㎡": "m2", "ﬁ": "fi"}


@pytest.mark.parametrize("raw,folded", FOLDS.items())
def test_fold(raw, folded):
    assert text.fold_py(raw) == folded


@pytest.mark.parametrize("a,b", [("Београд", "Beograd"), ("Львів", "Lviv"), ("Мінск", "Minsk")])
def test_scripts_meet(a, b):
    assert text.fold_py(a) == text.fold_py(b)


@given(st.text(max_size=30))
def test_fold_is_idempotent(s):
    assert text.fold_py(text.fold_py(s)) == text.fold_py(s)


def test_tokens():
    assert text.tokens_py("ul. Marszałkowska") == ["marszalkowska"]
    assert text.tokens_py("nám. Míru") == ["miru"]
    assert text.tokens_py("Rynek") == ["rynek"]
    assert text.tokens_py("千代田区") == ["千代", "代田", "田区"]
    assert text.tokens_py("日") == ["日"]
    assert text.index_tokens_py("München") == ["munchen", "muenchen"]
    assert text.index_tokens_py("Grünstraße") == ["grunstrasse", "gruenstrasse"]
    assert "schlosstrasse" in text.index_tokens_py("Schloßstraße") or "schlosstrasse" in text.token_variants_py("schlossstrasse")


@pytest.mark.parametrize("name", ["Neue", "Aue", "Steuerweg", "Bauernhof", "Museum"])
def test_no_false_digraph(name):
    assert text.collapse_digraphs(text.fold_py(name)) == text.fold_py(name)


def test_native_fold_equals_python(spark):
    rows = [(x,) for x in [*FOLDS, "Köln Straße", "Ñandú", "", None, "½ ² Ω", "ÉCOLE"]]
    df = spark.createDataFrame(rows, "s string").select("s", text.fold(F.col("s")).alias("f")).collect()
    assert all(r.f == (None if r.s is None else text.fold_py(r.s)) for r in df)


def test_distance(spark):
    d = spark.range(1).select(geo.haversine_m(F.lit(50.0755), F.lit(14.4378), F.lit(49.1951), F.lit(16.6068)).alias("d")).first().d
    assert 183_000 < d < 186_000


def test_contains_notch_and_distance(spark):
    ell = "array(named_struct('lat',0d,'lon',0d),named_struct('lat',0d,'lon',2d),named_struct('lat',1d,'lon',2d),named_struct('lat',1d,'lon',1d),named_struct('lat',2d,'lon',1d),named_struct('lat',2d,'lon',0d))"
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (1.5, 0.5), (3.0, 0.5)], "lat double, lon double").withColumn("ring", F.expr(ell))
    assert [r.x for r in df.select(geo.contains(F.col("ring"), F.col("lat"), F.col("lon")).alias("x")).collect()] == [True, False, True, False]
    d = df.select(geo.distance_to_shape_m(F.col("ring"), F.lit(True), F.col("lat"), F.col("lon")).alias("d"), geo.distance_to_shape_m(F.col("ring"), F.lit(False), F.col("lat"), F.col("lon")).alias("v")).collect()
    assert abs(d[3].d - 111320) < 1 and all(r.v >= r.d for r in d)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(42)
    pts = [(i, 48 + rng.random() * 0.1, 9 + rng.random() * 0.1) for i in range(60)]
    feats = [(i, 48 + rng.random() * 0.1, 9 + rng.random() * 0.1) for i in range(400)]
    got = reverse.nearest(spark.createDataFrame(pts, "point_id long, lat double, lon double"), spark.createDataFrame(feats, "feature_id long, lat double, lon double"), 3, 3000.0).collect()

    def m(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(x))

    want = {(p, f, r + 1) for p, a, b in pts for r, (d, f) in enumerate(sorted((m(a, b, c, e), f) for f, c, e in feats)[:3]) if d <= 3000}
    assert {(r.point_id, r.feature_id, r["rank"]) for r in got} == want


def test_poi_and_alias_tags(spark):
    rows = [({"name": "A", "amenity": "no", "shop": "mall"},), ({"name": "B", "amenity": "bar", "disused": "yes"},), ({"amenity": "bar"},), ({"name": "D", "name:en": "Dee; D", "alt_name": "Da"},)]
    df = spark.createDataFrame(rows, "t map<string,string>")
    assert [r.c for r in df.select(features.poi_category(F.col("t")).alias("c")).collect()] == ["shop=mall", None, None, None]
    assert df.select(features.alt_names(F.col("t")).alias("a")).collect()[3].a == ["Da", "Dee"]


def test_relevance_prefers_exact(spark):
    df = spark.sql("select array('stara','praha') q, array(array('stara','praha'), array('praha')) v, array('brno') l union all select array('praha'), array(array('stara','praha')), array('brno')")
    a, b = [r.s for r in df.select(forward.best_relevance(F.col("q"), F.col("v"), F.col("l")).alias("s")).collect()]
    assert abs(a - 2.5) < 1e-9 and a > b


@pytest.mark.parametrize("s,n", [("12/3", 12), ("ev.7", 7), ("x", 0), ("99999999999", 0), ("3000000000", 2147483648)])
def test_leading_int(spark, s, n):
    assert spark.createDataFrame([(s,)], "s string").select(index.leading_int(F.col("s")).alias("n")).first().n == n


def test_house_precedence(spark):
    a = spark.createDataFrame([(1, 5, "248/39"), (2, 5, "39"), (3, 5, "248")], "address_id long, anchor_id long, house_number string")
    q = spark.createDataFrame([(1, 5, "cz", "248/39"), (2, 5, "cz", "39"), (3, 5, "de", "240"), (4, 5, "cz", "248")], "query_id long, anchor_id long, country string, number string")
    got = {r.query_id: (r.address_id, r.factor) for r in forward.match_house(q, a).collect()}
    assert got == {1: (1, 18.0), 2: (2, 18.0), 3: (None, 0.4), 4: (3, 18.0)}
