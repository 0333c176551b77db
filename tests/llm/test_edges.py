"""Edges of the training-data operators: large ids beside nulls, clashing names, repeated ids, hot groups, very long texts; brute force."""

import collections
import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelark.llm import common, decontamination, html_extract, license_scan, line_dedup, mixing, near_dedup, quality_rules, sharding, substring_dedup, tool_calls
from test_operators import DIR, brute_components, brute_distance, lower, words

BIG = 2**53 + 1
TEXTS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_large_ids_beside_nulls(spark):
    d = spark.createDataFrame([(BIG, "the mit license " * 9), (None, "x " * 30), (BIG + 2, None)], TEXTS).coalesce(1)
    items = spark.createDataFrame([(BIG, "the mit license")], "item_id long, text string")
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.col("text").alias("html"))
    want = {BIG, None, BIG + 2}
    assert {r.page_id for r in html_extract.extract(pages).collect()} == want
    for run in (sharding.shuffle_shards, license_scan.scan_licenses, substring_dedup.dedup_substrings, near_dedup.near_duplicates):
        assert {r.doc_id for r in run(d).collect()} == want
    assert [(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, items).collect()] == [(BIG, BIG)]
    assert {r.doc_id for r in decontamination.decontaminate(d, items).collect()} == {None, BIG + 2}


def test_empty_tables_and_other_columns(spark):
    pages = spark.createDataFrame([(None, None, None, 1, "h")], "page_id long, url string, html string, text int, host string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect()] == [(None, "", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0
    d = spark.createDataFrame([(1, "some text", 5, "r", "k", 3)], "doc_id long, text string, _id int, row string, _key string, item_id int")
    items = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert [tuple(r) for r in decontamination.decontaminate(d, items.limit(0)).collect()] == [tuple(d.first())]
    assert decontamination.decontaminate(d, items).count() == 0 and decontamination.find_leaks(d.limit(0), items).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "x", "level", 9)], "conv_id long, turn long, role string, text string, status string, item int")
    assert [r.status for r in tool_calls.link_calls(turns).collect()] == ["text"]


# --- html ---------------------------------------------------------------------------------------------------------------
def test_html_attributes():
    texts = lambda s: [t for _, _, t in html_extract.blocks(s)]
    assert texts("<p title=it's>One</p><p title='a > b'>Two</p><p title=\"x>y\">Three</p>") == ["One", "Two", "Three"]
    assert texts("<p>a" + '<b ="x"' * 4000) == ["a"]  # no backtracking


def test_html_salted_templates_equal_broadcast_ones(spark, monkeypatch):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").limit(40).repartition(2).cache()
    one = {tuple(r) for r in html_extract.extract(pages).collect()}
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(html_extract, "SALT_PAGES", 3)
    assert {tuple(r) for r in html_extract.extract(pages).collect()} == one


def test_html_neutral_names_by_brute_force(spark):
    """No tag or class says what is boilerplate: blocks that all pages of a host share are the template, the rest is text."""
    rng, rows, want = random.Random(4), [], {}
    for h in range(3):
        top, end = ([f"{w} {h} {i}" for i in range(3)] for w in ("top", "end"))
        for i in range(8):
            own = [f"own {h} {i} {k} {rng.random()}" for k in range(rng.randint(2, 6))]
            body = "".join(f"<div class=r{k}><span>{x}</span></div>" for k, x in enumerate(top)) + "<div class=c>" + "".join(f"<p>{x}</p>" for x in own) + "</div>" + "".join(f"<div class=s{k}>{x}</div>" for k, x in enumerate(end))
            rows.append((10 * h + i, f"http://h{h}.example/{i}", f"<html><body>{body}</body></html>"))
            want[10 * h + i] = " ".join(own)
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want
    alone = html_extract.extract(spark.createDataFrame(rows[:1], "page_id long, url string, html string")).first()
    assert alone.text != want[0]  # without other pages there is no template to tell


# --- shards -------------------------------------------------------------------------------------------------------------
def test_written_shards(spark, docs, tmp_path):
    want = {(r.shard, r.slot): r.doc_id for r in sharding.shuffle_shards(docs, bucket_bytes=50_000).collect()}
    sharding.write_shards(docs, str(tmp_path / "s"), bucket_bytes=50_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r.shard, r.slot): r.doc_id for r in back.collect()} == want
    for f in (tmp_path / "s" / "shard=3").glob("*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(f)).coalesce(1).collect()]
        assert slots == sorted(slots)


def test_shards_are_shuffled_and_seeded(docs):
    a, b = ({r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_shards(docs, seed=s).collect()} for s in (1, 2))
    assert a != b
    order = [i for i, _ in sorted(a.items(), key=lambda x: x[1][::-1])]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3


# --- licenses -----------------------------------------------------------------------------------------------------------
def test_license_spans():
    scan = license_scan.scanner()
    assert [(s[0], s[1]) for s in scan("mit licenze mit licence mit licanse")[7]] == [(0, 11), (12, 23), (24, 35)]
    assert scan("the mit licenseeeee thing")[5:] == ("", 0.0, [])
    assert scan("mit license " * 3)[1:4] == (3, 0, 4)


def test_license_base_by_brute_force(docs):
    word = re.compile(license_scan.WORD)
    phrases = {tuple(p.split()): v for p, v in license_scan.BASE.items()}
    for r, t in zip(license_scan.scan_licenses(docs.coalesce(1)).collect(), docs.coalesce(1).collect(), strict=True):
        w = word.findall(lower(t.text))
        hits = [(i, v) for i in range(len(w)) for p, v in phrases.items() if tuple(w[i : i + len(p)]) == p]
        assert (r.doc_id, r.n_words, r.n_base) == (t.doc_id, len(w), len(hits))
        assert (r.first_word, r.last_word) == (min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({v for _, v in hits})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_license_fuzzy_by_brute_force():
    rng = random.Random(2)
    scan, phrase = license_scan.scanner(), "mozilla public license"
    k = len(phrase) // license_scan.PER_ERROR
    for _ in range(300):
        t = list(phrase)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t))
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "qz"])
        text = "".join(t).strip()
        labels = scan(f"aaa {text} bbb")[5].split(",")
        flat = " ".join(re.findall(license_scan.WORD, text))
        parts_ = flat.split()
        best = min(distance(phrase, " ".join(parts_[a:b])) for a in range(len(parts_)) for b in range(a + 1, len(parts_) + 1))
        if best <= k:
            assert "mpl" in labels


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


# --- lines --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("share", [line_dedup.HOT_SHARE, 0.05, 2.0])
def test_lines_of_one_id(spark, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    rows = [(1, "common line of all\nonly in one aaaa"), (2, "x\ncommon line of all"), (2, "unique bbbbbbbbbbbb\ncommon line of all"), (None, "common line of all"), (3, "common line of all\n" * 300 + "end")]
    got = {(r.doc_id, r.n_lines): (r.n_dropped, r.kept) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got[None, 1] == (0, "common line of all") and got[1, 2] == (1, "only in one aaaa") and got[3, 301] == (300, "end")
    rows_2 = line_dedup.dedup_lines(spark.createDataFrame(rows, TEXTS)).filter("doc_id = 2").collect()
    assert {(r.n_dropped, r.kept) for r in rows_2} == {(1, "x"), (1, "unique bbbbbbbbbbbb")}
    three = line_dedup.dedup_lines(spark.createDataFrame(rows, TEXTS), min_docs=3).filter("doc_id = 1").first()
    assert three.n_dropped == 1


# --- benchmark passages -------------------------------------------------------------------------------------------------
def test_inexact_leaks_by_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(10, 25))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = list(rng.choice(items))
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y z"])
        rows.append((i, f"{word()} {word()} {''.join(t)} {word()}"))
    want = {}
    for d, t in rows:
        for i, item in enumerate(items):
            n = brute_distance(item, decontamination.normal(t))
            if n <= len(item) // decontamination.PER_EDIT:
                want[d, i] = n
    got = decontamination.find_leaks(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == want and len(set(want.values())) > 3


def test_items_in_blocks(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    whole = sorted(tuple(r) for r in decontamination.find_leaks(docs, items).collect())
    left = {r.doc_id for r in decontamination.decontaminate(docs, items).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 3000)
    assert sorted(tuple(r) for r in decontamination.find_leaks(docs, items).collect()) == whole
    assert {r.doc_id for r in decontamination.decontaminate(docs, items).collect()} == left == {r.doc_id for r in docs.collect()} - {x[0] for x in whole}


# --- substrings ---------------------------------------------------------------------------------------------------------
def test_substrings_of_null_and_repeated_ids(spark):
    seq = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    inner = seq("r", 25) + " mid " + seq("r", 25)
    rows = [(None, seq("n", 60)), (None, inner), (5, seq("a", 30)), (5, seq("b", 30)), (6, seq("c", 30)), (6, seq("c", 30)), (7, seq("a", 30)), (8, seq("n", 60))]
    for n in (1, 5):
        got = sorted(((r.doc_id or 0, r.kept.split()[0] if r.kept else "", r.n_removed) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, TEXTS).repartition(n)).collect()))
        assert got == sorted([(0, "n0", 0), (0, "r0", 25), (5, "a0", 0), (5, "b0", 0), (6, "c0", 0), (6, "c0", 0), (7, "", 30), (8, "", 60)])


def test_parts_hold_each_window_once():
    norm = " ".join(f"w{i % 97}" for i in range(3000)).encode()
    whole = common.window_hashes(norm, 20)[0]
    got = np.concatenate([common.window_hashes(p, 20)[0] for _, p in common.parts(norm, 20, 700)])
    assert (got == whole).all() and len(list(common.parts(norm, 20, 700))) > 15
    assert [a for a, _ in common.parts(b"a " * 30 + b"b" * 900 + b" c" * 30, 5, 100)][0] == 0


# --- near copies --------------------------------------------------------------------------------------------------------
def test_near_in_tiny_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == want


def test_near_groups_that_the_center_does_not_hold(spark, monkeypatch):
    """Two clusters that share most of their bands' words, and loose texts between: links go past the group's center."""
    rng, rows = random.Random(6), []
    basis = [f"b{i}" for i in range(150)]
    for k in range(60):
        w = list(basis)
        if k % 2:
            for i in range(0, 20, 2):
                w[i] = f"other{i}"
        for i in rng.sample(range(30, 150), rng.randint(0, 4)):
            w[i] = f"own{k}x{i}"
        rows.append((k, " ".join(w)))
    want = brute_components(rows)
    assert 2 < len({c for _, c in want.values()}) < 60
    for group, block in ((4, 700), (500, 50_000)):
        monkeypatch.setattr(near_dedup, "GROUP", group)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t), (4, t), (4, t), (9, t + " end"), (2, ""), (3, "one two"), (3, "other words here")]
    d = spark.createDataFrame(rows, TEXTS)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(d).collect())
    assert got == [(0, 36, 0, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (4, 36, 4, True), (4, 36, 4, True), (9, 37, 4, False)]
    kept = sorted((r.doc_id or 0, r.text) for r in near_dedup.keep_one(d).collect())
    assert kept == sorted([(0, t), (4, t), (2, ""), (3, "one two"), (3, "other words here")])


# --- tool calls ---------------------------------------------------------------------------------------------------------
def turns_of(spark, turns, conv=1):
    return spark.createDataFrame([(conv, i, "assistant", json.dumps(x) if isinstance(x, dict) else x) for i, x in enumerate(turns)], "conv_id long, turn long, role string, text string")


def test_turns_are_ordered_topologically(spark):
    """Against all orders by brute force: every result after its call, and turns in their order where nothing moves them."""
    call = lambda *ids: [{"id": i, "name": "search", "arguments": {"query": "x"}} for i in ids]
    turns = [
        "hello", {"tool_call_id": "b", "content": 1, "tool_calls": call("c")}, {"tool_call_id": "c", "content": 2}, "between", {"tool_calls": call("a")},
        {"tool_call_id": "d", "content": 0}, {"tool_call_id": "a", "content": 3, "tool_calls": call("b", "d")}, "end", {"tool_call_id": "s", "content": 4, "tool_calls": call("s")},
    ]
    got = tool_calls.link_calls(turns_of(spark, turns)).collect()
    order = [(r.turn, r.item, r.status) for r in sorted(got, key=lambda r: (r.order_turn, r.order_depth, r.turn, r.order_item))]
    assert [t for t in dict.fromkeys(t for t, _, _ in order)] == [0, 3, 4, 6, 1, 5, 2, 7, 8]
    at = {(r.call_id, r.status): i for i, r in enumerate(sorted(got, key=lambda r: (r.order_turn, r.order_depth, r.turn, r.order_item)))}
    assert all(at[k, "call"] < at[k, "result"] for k in "abcds")


def test_cycles_of_turns_end(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "MAX_CHAIN", 4)
    call = lambda i: [{"id": i, "name": "search", "arguments": {"query": "x"}}]
    turns = [{"tool_call_id": "y", "tool_calls": call("x")}, {"tool_call_id": "x", "tool_calls": call("y")}]
    got = tool_calls.link_calls(turns_of(spark, turns)).collect()
    assert len(got) == 4 and {r.status for r in got} == {"call", "result"}


def test_schemas_as_a_table(spark):
    schema = {
        "type": "object", "required": ["place"], "additionalProperties": False,
        "properties": {
            "place": {"type": "object", "required": ["lat"], "properties": {"lat": {"type": "number", "minimum": -90, "maximum": 90}, "name": {"type": "string", "minLength": 2, "pattern": "^[A-Z]"}}},
            "kinds": {"type": "array", "maxItems": 3, "items": {"enum": ["a", 1, None]}}, "mode": {"const": "fast"}, "limit": {"type": ["integer", "null"]},
        },
    }
    tools = spark.createDataFrame([("near", json.dumps(schema)), ("free", "{}")], "name string, schema string")
    cases = [
        ("near", {"place": {"lat": 1.5, "name": "Xy", "more": [1]}, "kinds": ["a", 1, None], "mode": "fast", "limit": None}, "call"), ("near", {}, "invalid: missing place"), ("near", None, "invalid: missing place"),
        ("near", {"place": {}}, "invalid: missing place.lat"), ("near", {"place": {"lat": 91}}, "invalid: maximum of place.lat"), ("near", {"place": {"lat": "1"}}, "invalid: type of place.lat"),
        ("near", {"place": {"lat": 1, "name": "X"}}, "invalid: minLength of place.name"), ("near", {"place": {"lat": 1, "name": "xy"}}, "invalid: pattern of place.name"), ("near", {"place": [1]}, "invalid: type of place"),
        ("near", {"place": {"lat": 1}, "kinds": ["a", "b"]}, "invalid: value of kinds[]"), ("near", {"place": {"lat": 1}, "kinds": [1, 1, 1, 1]}, "invalid: maxItems of kinds"), ("near", {"place": {"lat": 1}, "mode": "slow"}, "invalid: value of mode"),
        ("near", {"place": {"lat": 1}, "limit": 1.5}, "invalid: type of limit"), ("near", {"place": {"lat": 1}, "x": 1}, "invalid: unknown argument"), ("free", {"z": 1}, "call"), (None, {}, "invalid: no name"), ("search", {}, "invalid: unknown tool"),
    ]
    calls = [{"id": f"c{i}", "name": n, "arguments": a} for i, (n, a, _) in enumerate(cases)]
    turns = [{"tool_calls": calls}] + [{"tool_call_id": f"c{i}", "content": None} for i in range(len(cases))]
    got = {r.call_id: r.status for r in tool_calls.link_calls(turns_of(spark, turns), tools=tools).collect() if r.status != "result"}
    assert got == {f"c{i}": s for i, (_, _, s) in enumerate(cases)}
    with pytest.raises(ValueError):
        tool_calls.link_calls(turns_of(spark, ["x"]), tools={"t": {"oneOf": []}})
    with pytest.raises(ValueError):
        tool_calls.link_calls(turns_of(spark, ["x"]), tools=tools.unionByName(tools))


def test_json_is_canonical(spark):
    payload = {"z": {"b": [{"y": 1, "x": None}], "a": "é\n"}, "a": 2.5, "query": "q"}
    text = json.dumps({"tool_calls": [{"name": "search", "id": "i", "arguments": payload}]}, indent=2)
    got = tool_calls.link_calls(turns_of(spark, [text])).first()
    assert got.json == tool_calls.canonical({"arguments": payload, "id": "i", "name": "search", "role": "assistant"})


# --- quality ------------------------------------------------------------------------------------------------------------
def python_verdict(t):
    """Names of the rules of the method that reject a text, without the operator."""
    t = t or ""
    w = words(t)
    chars = sum(map(len, w))
    ls = [x for x in t.split("\n") if words(x)]
    letters = [c for c in t if unicodedata.category(c)[0] == "L"]
    capitals = [c for c in letters if unicodedata.category(c) == "Lu"]
    d = len(set(w))
    tests = {
        "symbols": 10 * len(re.findall(r"[#*$%&|<>]", t)) > chars, "duplicate_lines": len(ls) >= 5 and 10 * (len(ls) - len(set(ls))) > 4 * len(ls), "long_words": chars > 40 * len(w),
        "capitals": len(letters) > 50 and 10 * len(capitals) > 7 * len(letters), "no_letters": 4 * len(letters) < chars, "few_words": len(w) >= 20 and 20 * d < len(w) and d * d < 5 * len(w),
    }
    return {k for k, v in tests.items() if v}


def test_verdict_by_brute_force(spark, docs):
    extra = [(10**6 + i, t) for i, t in enumerate(["word " * 30 + "# " * 40, "LOUD WORDS " * 30, "1234 5678 " * 30, "x" * 3000 + " a" * 25, "\n".join(["same line here a b c d e f"] * 6), "a\n\n" * 40, "é ß Ω 語 " * 10])]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, TEXTS))
    seen = collections.Counter()
    for r in quality_rules.apply_rules(both).collect():
        bad = python_verdict(r.text)
        assert r.kept == (not r.base_failed and not bad)
        assert r.rejected_by is None if r.kept else r.rejected_by == "base" if r.base_failed else r.rejected_by in bad
        seen[r.rejected_by] += 1
    assert len(seen) >= 3
    short = {r.doc_id: r.kept for r in quality_rules.verdicts(both).collect()}
    assert short == {r.doc_id: r.kept for r in quality_rules.apply_rules(both).collect()}


def test_cascade_is_stable_and_by_ratio(docs):
    a, b = ([(r.name, s, c) for r, s, c in quality_rules.order_rules(docs, [*quality_rules.BASE, *quality_rules.RULES])] for _ in range(2))
    assert a == b and [s / c for _, s, c in a] == sorted((s / c for _, s, c in a), reverse=True)
    assert len(quality_rules.order_rules(docs.limit(0), quality_rules.RULES)) == len(quality_rules.RULES)


# --- mixing -------------------------------------------------------------------------------------------------------------
def test_mix_refuses_too_many_sources(spark, monkeypatch):
    d = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "MAX_SOURCES", 4)
    with pytest.raises(ValueError):
        mixing.mix(d)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 5)
    monkeypatch.setattr(mixing, "ALL_BLOCKS", 10)
    rows = mixing.mix(d).collect()
    assert len(rows) == 5 and all(r.taken <= 3 * r.size for r in rows)


def test_mix_deviates_little(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = mixing.mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).select("source", "target", "taken").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
        assert all(abs(r.n - r.t) <= max(20, 0.0005 * r.t) for r in rows)


# --- pipeline -----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


CLASH = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, target string, taken string, _copies string, _key string, row string, shard int, slot string, rejected_by string"


def test_stages_on_odd_tables(spark, pipeline):
    good = lambda p: " ".join(f"{p}word{chr(97 + i % 26)}{i}" for i in range(60))
    rest = ("k", "z", "t", "n", "c", "y", "w", 7, "l", "r")
    rows = [(1, good("a"), "en", "a", 9), (2, good("a") + " tail", "en", None, 9), (3, None, None, None, None), (4, "", "en", "b", 0), (None, good("b"), "en", "b", BIG), (5, good("c"), None, "b", None), (5, good("c"), None, "b", None), (6, good("d") + " é" * 50_000, "fr", "c", 1)]
    d = spark.createDataFrame([(*r, *rest) for r in rows], CLASH)
    for name, stage in pipeline.STAGES:
        assert stage(spark, d.limit(0), DIR).count() == 0
        out = stage(spark, d, DIR)
        if name != "sharding":
            assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString()
            assert all(tuple(r)[5:] == rest for r in out.collect())
            assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in d.collect()}
        else:
            assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(r[0] for r in rows)
    ids = lambda name: sorted(r.doc_id or 0 for r in dict(pipeline.STAGES)[name](spark, d, DIR).collect())
    assert ids("quality") == [0, 1, 2, 5, 5]
    assert ids("near_dedup") == [0, 1, 3, 4, 5, 6]
    assert ids("decontamination") == [0, 1, 2, 3, 4, 5, 5, 6]


def test_stages_by_brute_force(spark, docs, pipeline):
    stages, texts = dict(pipeline.STAGES), [(r.doc_id, r.text) for r in docs.collect()]
    ids = lambda df: {r.doc_id for r in df.collect()}
    base = {r.doc_id: r.base_failed for r in quality_rules.apply_rules(docs).collect()}
    assert ids(stages["quality"](spark, docs, DIR)) == {d for d, t in texts if not base[d] and not python_verdict(t)}
    assert ids(stages["near_dedup"](spark, docs, DIR)) == {d for d, (_, c) in brute_components(texts).items() if d == c}
    assert ids(stages["decontamination"](spark, docs, DIR)) == ids(docs) - {r.doc_id for r in decontamination.find_leaks(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    size = {d: len(words(t)) for d, t in texts}
    got = collections.Counter(r.doc_id for r in stages["mixing"](spark, docs, DIR).collect())
    assert {d: n * size[d] for d, n in got.items()} == {d: n for d, n in taken.items() if n}
