"""Readings, rings, selections, rendering and streams."""

import math

import pytest
from pyspark.sql import functions as F

from placelark.functions import query
from placelark.functions.priors import CATCHMENT_KM
from placelark.operators import features, render, reverse, shapes
from placelark.sources import catalog
from placelark.streaming import geocode


@pytest.mark.parametrize(
    "q,number",
    [("Prazska 248/39", "248/39"), ("Via Roma 1 Torino", "1"), ("10 Downing Street", None), ("Bratislavska 22, 602 00 Brno", "22"), ("Hauptstrasse 5, 10115 Berlin", "5"), ("Praha", None)],
)
def test_first_reading(q, number):
    assert query.readings(q)[0]["number"] == number


def test_postcode_is_no_number_first():
    got = [r["number"] for r in query.readings("Hauptstrasse 5, 10115 Berlin")]
    assert got[0] == "5" and "10115" in got


def test_runs():
    assert query.runs("Bratislavska 334/36, 602 00 Brno") == ["334/36", "602", "00"]
    assert query.runs("85th Street 78-52") == ["78-52"]


def test_stitch(spark):
    p = lambda a, b: {"lat": float(a), "lon": float(b)}
    ways = [{"first": 1, "last": 2, "pts": [p(0, 0), p(0, 1)]}, {"first": 4, "last": 3, "pts": [p(1, 0), p(1, 1)]}, {"first": 2, "last": 3, "pts": [p(0, 1), p(1, 1)]}, {"first": 1, "last": 4, "pts": [p(0, 0), p(1, 0)]}]
    ring = shapes.stitch(ways)
    assert ring[0] == ring[-1] and shapes.shoelace(ring) == 1.0
    assert shapes.stitch(ways[:3]) == []
    rows = [(7, i, w["first"], w["last"], w["pts"]) for i, w in enumerate(ways)]
    df = spark.createDataFrame(rows, "rel_id long, seq int, first long, last long, pts array<struct<lat:double,lon:double>>")
    assert [r.rel_id for r in shapes.stitched(df).collect()] == [7]


def test_simplify():
    line = [(0.0, i / 1000) for i in range(50)]
    assert shapes.simplify(line) == [line[0], line[-1]]
    circle = [(math.sin(i / 50) * 0.1, math.cos(i / 50) * 0.1) for i in range(314)]
    assert len(shapes.simplify(circle)) <= shapes.MAX_POINTS


def test_representative():
    assert shapes.representative([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]) == pytest.approx((0.5, 0.5))
    assert shapes.representative([(1.0, 2.0)]) == (1.0, 2.0)


def test_selection(spark):
    c = spark.createDataFrame([("cz", "europe/czech", 5, "Czechia"), ("pl", "europe/poland", 9, "Poland"), ("lv", "europe/latvia", 1, "Latvia"), ("lt", "europe/lithuania", 1, "Lithuania")], catalog.COUNTRIES)
    g = spark.createDataFrame([("baltics", "lt,lv")], catalog.GROUPS)
    code = lambda s: [r.code for r in catalog.resolve(s, c, g).collect()]
    assert code("cz,pl") == ["cz", "pl"] and code("@baltics,lv,pl") == ["lt", "lv", "pl"]
    for bad in ("zz", "@nosuchgroup", " , "):
        with pytest.raises(ValueError):
            catalog.resolve(bad, c, g)


def test_requests(spark):
    rows = [("a", None, None, 5, 100.0, "cz"), (None, 1.0, 2.0, 5, 100.0, None), (None, None, None, 5, 1.0, None), ("a", 1.0, 2.0, 5, 1.0, None), ("a", None, None, 99, 1.0, None), (None, 91.0, 2.0, 5, 1.0, None)]
    df = spark.createDataFrame(rows, "q string, lat double, lon double, limit int, radius double, country string")
    assert [r.e for r in df.select(render.request_error(df).alias("e")).collect()] == [None, None, "neither q nor a point", "q and a point", "limit", "coordinates"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Praha"), (2, "nowhere")], "query_id long, q string").write.parquet(str(tmp_path / "in"))
    anchors = spark.createDataFrame([(5, "PRAHA", "cz")], "anchor_id long, name string, country string")
    stream = spark.readStream.schema("query_id long, q string").parquet(str(tmp_path / "in"))
    q = geocode.lookup(stream, anchors).writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.query_id, r.anchor_id) for r in spark.sql("SELECT * FROM hits").collect()] == [(1, 5)]


def test_debounce_is_one_row_a_session(spark):
    df = spark.sql("SELECT * FROM VALUES ('u', 'p', timestamp'2024-01-01 00:00:00.000'), ('u', 'pr', timestamp'2024-01-01 00:00:00.100'), ('u', 'x', timestamp'2024-01-01 00:00:05') AS t(user, q, ts)")
    assert sorted(r.q for r in geocode.debounce(df).select(F.col("q")).collect()) == ["pr", "x"]


def test_nearest_and_catchment_far_north(spark):
    def metres(a, b):
        (la, lo), (lb, lp) = (tuple(math.radians(x) for x in p) for p in (a, b))
        return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2))

    kind, km = min(CATCHMENT_KM.items(), key=lambda x: x[1])
    points = [(10 * i + j, lat, lon) for i, lat in enumerate((0.0, 47.0, 70.0, 80.0, -80.0, 89.99)) for j, lon in enumerate((18.9001, 20.01, 179.999, -179.9999))]
    for radius in (2000.0, km * 1000.0):
        feats = []
        for i, lat, lon in points:
            at = math.degrees(radius / 6371008.8)
            for k in (0.85, 0.95, 0.9995):
                dlon = 2 * math.degrees(math.asin(min(1.0, math.sin(math.radians(at * k) / 2) / math.cos(math.radians(lat)))))
                feats += [(lat, (lon + s * dlon + 180) % 360 - 180) for s in (-1, 1)] + [(min(90.0, lat + k * at), lon)]
        feats = [(1000 + i, *x) for i, x in enumerate(feats)]
        p = spark.createDataFrame(points, "point_id long, lat double, lon double")
        f = spark.createDataFrame(feats, "feature_id long, lat double, lon double")
        want = {(a, b) for a, *x in points for b, *y in feats if metres(x, y) <= radius}
        assert {(r.point_id, r.feature_id) for r in reverse.nearest(p, f, 1000, radius).collect()} == want
    rows = spark.createDataFrame([(b, "no", y, x) for b, y, x in feats], "id long, country string, lat double, lon double")
    places = spark.createDataFrame([(a, "no", kind, y, x) for a, y, x in points], "place_id long, country string, place_type string, lat double, lon double")
    got = {r.id for r in features.catchment(rows, places, keep_all=False).collect()}
    assert got == {b for _, b in want}


def test_representative_point_of_every_shape(spark):
    from placelark.plans import catalogue
    from placelark.sources import corpus

    d = "/root/testdata/sf0.001"
    rings = {r.shape_id: [(p.lat, p.lon) for p in r.ring] for r in corpus.shapes(spark, d).select("shape_id", "ring").collect()}
    got = {r.shape_id: (r.lat, r.lon) for r in catalogue.QUERIES["representative_point"](spark, d).collect()}
    assert got.keys() == rings.keys() and any(k % 2 for k in got)
    for k, ring in rings.items():  # by midpoints of strips between the vertices' latitudes
        a = y = x = 0.0
        cuts = sorted({p[0] for p in ring})
        for lo, hi in zip(cuts, cuts[1:]):
            mid = (lo + hi) / 2
            xs = sorted(p[1] for p, q in zip(ring, ring[1:] + ring[:1]) if (p[0] > mid) != (q[0] > mid))
            for w, e in zip(xs[::2], xs[1::2]):
                s = (hi - lo) * (e - w)
                a, y, x = a + s, y + s * mid, x + s * (w + e) / 2
        assert got[k] == pytest.approx((y / a, x / a), abs=2e-6)
