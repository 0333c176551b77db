"""Map extracts, features, records and the engine over a stored index."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from placelark.operators import extract, records
from placelark.plans.geocoder import Geocoder
from placelark.sources import pbf


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


zigzag = lambda n: n << 1 if n >= 0 else (-n << 1) - 1
whole = lambda k, n: varint(k << 3) + varint(n)
part = lambda k, b: varint(k << 3 | 2) + varint(len(b)) + b
many = lambda k, ns: part(k, b"".join(varint(n) for n in ns))


def deltas(ns):
    return [zigzag(b - a) for a, b in zip([0, *ns], ns)]  # noqa: B905


def blob(kind, data, squeeze=True):
    b = whole(2, len(data)) + part(3, zlib.compress(data)) if squeeze else part(1, data)
    head = part(1, kind.encode()) + whole(3, len(b))
    return struct.pack(">I", len(head)) + head + b


NODES = [(1, 50.0, 14.0), (2, 50.0, 14.01), (3, 50.01, 14.01), (4, 50.01, 14.0), (5, -33.5, -70.25)]
WORDS = ["", "name", "Park", "leisure", "park", "highway", "residential", "Main", "type", "multipolygon", "outer", "amenity", "cafe", "Bar"]
at = WORDS.index


@pytest.fixture
def path(tmp_path):
    raw = [(i, round(a * 1e7), round(b * 1e7)) for i, a, b in NODES]
    kv = [0, 0, 0, 0, at("name"), at("Bar"), at("amenity"), at("cafe"), 0]
    dense = many(1, deltas([r[0] for r in raw])) + many(8, deltas([r[1] for r in raw])) + many(9, deltas([r[2] for r in raw])) + many(10, kv)
    table = part(1, b"".join(part(1, w.encode()) for w in WORDS))
    way = lambda i, tags, refs: part(3, whole(1, i) + many(2, [at(k) for k, _ in tags]) + many(3, [at(v) for _, v in tags]) + many(8, deltas(refs)))
    ways = way(10, [], [1, 2, 3]) + way(11, [], [1, 4, 3]) + way(12, [("name", "Main"), ("highway", "residential")], [1, 2, 3])
    tags = [("name", "Park"), ("leisure", "park"), ("type", "multipolygon")]
    rel = part(4, whole(1, 20) + many(2, [at(k) for k, _ in tags]) + many(3, [at(v) for _, v in tags]) + many(8, [at("outer")] * 2) + many(9, deltas([10, 11])) + many(10, [1, 1]))
    f = tmp_path / "x.osm.pbf"
    f.write_bytes(blob("OSMHeader", part(4, b"OsmSchema-V0.6") + part(4, b"DenseNodes")) + blob("OSMData", table + part(2, part(2, dense))) + blob("OSMData", table + part(2, ways) + part(2, rel), squeeze=False))
    return str(f)


def test_extract_to_records(spark, path, tmp_path):
    e = pbf.read(spark, path)
    got = {(r.kind, r.id): r for r in e.collect()}
    assert [(got["node", i].lat, got["node", i].lon) for i, _, _ in NODES] == [pytest.approx((a, b)) for _, a, b in NODES]
    assert got["node", 5].tags == {"name": "Bar", "amenity": "cafe"} and got["way", 11].refs == [1, 4, 3]
    assert [(m.type, m.ref, m.role) for m in got["relation", 20].members] == [("way", 10, "outer"), ("way", 11, "outer")]
    assert {r.kind for r in pbf.read(spark, path, "way").collect()} == {"way"}

    f = extract.features(e).withColumn("country", F.lit("cz"))
    rows = {(r.osm_type, r.osm_id): r for r in f.collect()}
    assert set(rows) == {("n", 5), ("w", 12), ("r", 20)}
    assert (rows["w", 12].lat, rows["w", 12].lon) == pytest.approx((50.0, 14.01))
    assert (rows["r", 20].lat, rows["r", 20].lon) == pytest.approx((50.005, 14.005)) and rows["r", 20].ring_closed

    r = records.from_tags(f)
    records.write_json(r, str(tmp_path / "records"))
    back = {x.id: x for x in records.read_json(spark, str(tmp_path / "records")).collect()}
    assert {k: (x.layer, x.display) for k, x in back.items()} == {"osm:n5#poi": ("poi", "Bar"), "osm:w12": ("street", "Main"), "osm:r20#poi": ("poi", "Park")}
    assert back["osm:n5#poi"].tokens == ["bar"]


def test_bad_extract(spark, tmp_path):
    (tmp_path / "bad").write_bytes(blob("OSMHeader", part(4, b"Unheard")))
    with pytest.raises(Exception, match="not supported"):
        pbf.read(spark, str(tmp_path / "bad")).collect()


def test_engine(spark, tmp_path):
    anchors = spark.createDataFrame(
        [(1, 0, "cz", "Main Street", "Praha", ["Hlavni"], None, 1.0, 50.0, 14.0), (2, 1, "cz", "Praha", "", [], None, 12.0, 50.08, 14.43), (3, 1, "pl", "Praga", "", [], None, 8.0, 52.2, 21.0)],
        "anchor_id long, layer int, country string, name string, locality string, alt_names array<string>, category string, prior double, lat double, lon double",
    )
    addresses = spark.createDataFrame([(7, 1, "12/3", 50.001, 14.001), (8, 1, "5", 50.002, 14.002)], "address_id long, anchor_id long, house_number string, lat double, lon double")
    Geocoder.build(anchors, addresses).write(str(tmp_path / "ix"))
    g = Geocoder.load(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "Main Street 5", None), (2, "Praha", None), (3, "Prahu", None), (4, "Praha", "pl"), (5, "nothing here", None)], "query_id long, q string, country string")
    got = {(r.query_id, r["rank"]): r for r in g.forward(q).collect()}
    assert (got[1, 1].anchor_id, got[1, 1].address_id, got[1, 1].house_number) == (1, 8, "5")
    assert got[2, 1].anchor_id == 2 and got[2, 1].corrected is None
    assert got[3, 1].anchor_id == 2 and got[3, 1].corrected == "praha"
    assert {k[0] for k in got} == {1, 2, 3}
    near = g.reverse(spark.createDataFrame([(1, 50.0011, 14.001, "CZ"), (2, 0.0, 0.0, "cz"), (3, 50.0011, 14.001, None)], "point_id long, lat double, lon double, country string"), radius=500.0)
    first = {r.point_id: r.address_id for r in near.filter("rank = 1").collect()}
    assert first == {1: 7, 3: 7}
    spark.createDataFrame([("anchors", 1, 3)], "name string, version int, n long").write.mode("overwrite").json(str(tmp_path / "ix" / "manifest"))
    with pytest.raises(ValueError):
        Geocoder.load(spark, str(tmp_path / "ix"))
