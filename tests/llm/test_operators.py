"""The training-data operators against brute force, and on odd tables."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from placelark.llm import decontamination, html_extract, license_scan, line_dedup, mixing, near_dedup, quality_rules, sharding, substring_dedup, tool_calls

WS = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _t string, shard int, size string"
base = " ".join(f"w{i}" for i in range(40))
near = base.replace("w39", "zz")
ODD = [
    (1, None, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, "x", "y", 3, "z"),
    (None, "null id text with a line that is long\nx", "en", "a", 5, None, None, None, None),
    (3, base + "\n" + base, "en", "b", 9, None, None, None, None),
    (4, base, "en", "b", 9, None, None, None, None),
    (4, base, "en", "b", 9, None, None, None, None),
    (5, near, "en", None, 9, None, None, None, None),
    (6, "\t\x0b  \n\n", "fr", "", 9, None, None, None, None),
    (7, "É x " * 6000 + "end", "fr", "c", 9, None, None, None, None),
    (8, "the MIT Licence text", "fr", "c", 9, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def words(t):
    return WS.findall(t or "")


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def ids(n_rows, df, col="doc_id"):
    rows = df.collect()
    assert len(rows) == n_rows
    return rows


OPERATORS = {
    "lines": line_dedup.dedup_lines,
    "shards": sharding.shuffle_shards,
    "quality": quality_rules.apply_rules,
    "mix": mixing.mix,
    "substrings": substring_dedup.dedup_substrings,
    "near": near_dedup.near_duplicates,
    "licenses": license_scan.scan_licenses,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, name):
    rows = OPERATORS[name](odd).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(x[0] for x in ODD)
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_lines(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d, t in sorted(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                first.setdefault(key(x), d)
    want = {}
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < 10 or first[key(x)] == d]
        want[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs).collect()} == want


def test_substrings(docs):
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        w = words(r.text)
        gone = set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone |= set(range(i, i + 20))
            seen.add(k)
        want[r.doc_id] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(docs).collect()} == want
    tiny = substring_dedup.dedup_substrings(docs, cells_log2=18).collect()  # a full sketch loses nothing
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in tiny} == want


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = words(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near(docs):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == want


def test_near_chain_in_small_blocks(spark, monkeypatch):
    # a chain: neighbours link, ends don't; groups and blocks far smaller than it
    w = [f"v{i}" for i in range(120)]
    rows = []
    for k in range(30):
        w[k * 4] = f"changed{k}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near_dedup, "GROUP", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 500)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_components(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, 101), (102, 101)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def test_quality(docs):
    for r, t in [(r, r.text) for r in quality_rules.apply_rules(docs).collect()]:
        w = words(t)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        gone = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        ls = [x for x in (t or "").split("\n") if WS.search(x)]
        failed = len(w) < 20 or 100 * len(gone) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(gone), failed)
        assert r.kept == (r.rejected_by is None) and not (failed and r.kept)


def test_quality_few_words_at_any_length(spark):
    import random

    rng = random.Random(5)
    text = lambda n, k: " ".join(f"word{chr(97 + x % 26)}{x}" for x in (rng.randrange(k) for _ in range(n)))
    cases = [(1, text(1999, 90)), (2, text(2000, 90)), (3, text(5000, 100)), (4, text(20_000, 250)), (5, text(5000, 400)), (6, text(20_000, 2000)), (7, text(1000, 300))]
    got = {r.doc_id: r.rejected_by for r in quality_rules.apply_rules(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert got == {1: "few_words", 2: "few_words", 3: "few_words", 4: "few_words", 5: None, 6: None, 7: None}


def test_quality_keeps_good_labels(spark, docs):
    good = spark.read.parquet(f"{DIR}/labels.parquet").filter("quality = 1").join(quality_rules.apply_rules(docs), "doc_id")
    assert good.filter("NOT kept AND NOT base_failed").count() == 0


def test_shards_are_even_and_repeatable(docs):
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_shards(docs, bucket_bytes=20_000).collect()}
    b = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_shards(docs.repartition(7), bucket_bytes=20_000).collect()}
    assert a == b
    by = collections.defaultdict(list)
    for s, k in a.values():
        by[s].append(k)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: len(words(r.text)) for r in docs.collect()}
    names = sorted({r.source for r in rows})
    size = collections.Counter()
    taken = collections.Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    goal = dict(zip(names, mixing.targets([size[n] for n in names], [i % 3 + 1 for i in range(len(names))], 3), strict=True))
    assert abs(sum(goal.values()) - sum(size.values())) < 1e-6
    for r in rows:
        assert abs(r.target - goal[r.source]) < 1e-6 and r.source_size == size[r.source]
    assert all(abs(taken[n] - goal[n]) <= 20 for n in names)


def test_materialised_mix_meets_its_targets(spark):
    n = lambda i: 20_000 if i == 77 else i % 120 + 3
    rows = [(i, "w " * n(i), s) for s in "abc" for i in range(600)] + [(7, "w w w", "a")] * 2 + [(9_000, "", "a"), (9_001, "w w", None)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    planned = mixed.collect()
    assert len(planned) == len(rows)
    got = mixing.materialise(mixed, ["doc_id", "source", "size", "mix_shard"]).collect()
    copies = collections.Counter((r.doc_id, r.source) for r in got)
    assert all((r.taken > 0) == (copies[r.doc_id, r.source] > 0) and r.taken == r.size * len(r.mix_shards) for r in planned)
    assert collections.Counter((r.doc_id, r.source, k) for r in planned for k in r.mix_shards) == collections.Counter((r.doc_id, r.source, r.mix_shard) for r in got)
    for s in "abc":
        words = sum(r.size for r in got if r.source == s)
        goal = next(r.target for r in planned if r.source == s)
        assert abs(words - goal) <= 20
    assert {r.mix_shard for r in got} == set(range(16))


def test_split_tree_is_exact():
    import numpy as np

    q = np.array([7, 0, 100, 31])
    t = mixing.split_tree(q, 5, 1)
    assert (t.sum(0) == q).all() and t.sum(1).max() - t.sum(1).min() <= 1


def brute_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        row = [i]
        for j, b in enumerate(t, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (a != b)))
        prev = row
    return min(prev)


def test_myers_equals_dynamic_programme():
    import random

    rng = random.Random(3)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (70, 90))
        got = decontamination.myers(p, t, len(p))
        assert got[0] == min(brute_distance(p, t), len(p)) or brute_distance(p, t) == len(p)


def test_leaks(spark):
    item = "the quick brown fox jumps over the lazy dog while nine zebras watch from afar and say nothing at all"
    edited = item.replace("quick", "quik").replace("zebras", "zebraz")
    rows = [(1, f"before {item.upper()} after"), (2, f"x\n{edited}\ny"), (3, item[:40]), (4, None), (5, ""), (None, item)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (10, None), (11, "short")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontamination.find_leaks(d, items).collect()} == {(1, 9, 0), (2, 9, 2), (None, 9, 0)}
    assert {r.doc_id for r in decontamination.decontaminate(d, items).collect()} == {3, 4, 5}
    assert decontamination.find_leaks(d, items.limit(0)).count() == 0


def test_short_leaks(spark):
    texts = ["Q: Who wrote  Hamlet? A.", "问题：水的化学式是什么？答", "他说日本の首都はどこですかと", "the party", "an art, old", "who wrote hamlets", "2+2=45", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "水的化学式是什么？"), (3, "日本の首都はどこですか"), (4, "art"), (5, "who wrote hamlet"), (6, "2+2=4"), (7, " "), (8, "")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.distance, r.item_chars) for r in decontamination.find_leaks(d, items).collect()]
    assert sorted(got) == [(0, 1, 0, 17), (0, 5, 0, 16), (1, 2, 0, 9), (2, 3, 0, 11), (4, 4, 0, 3)]
    assert {r.doc_id for r in decontamination.decontaminate(d, items).collect()} == {3, 5, 6, 7}


def test_planted_leaks_equal_substring_search(spark, docs):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    norm = decontamination.normal
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if norm(i.text) in norm(d.text)}
    got = decontamination.find_leaks(docs, items).collect()
    assert want == {(r.doc_id, r.item_id) for r in got if r.distance == 0}


def test_licenses():
    scan = license_scan.scanner()
    n, k, first, last, base_labels, labels, score, spans = scan("The MIT-License, then cc by 4.0; the Apache Licence.")
    assert (n, k, first, last, base_labels, labels, score) == (11, 2, 1, 4, "cc-by,mit", "apache,cc-by,mit", 1.0)
    assert any(s[2] == "apache" and s[3] == 1 for s in spans)
    assert scan(None)[:4] == (0, 0, None, None) and scan("plain words alone")[5:7] == ("", 0.0)


def test_html(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; tail</h1><p>One<b>two</b>\n three<p>four</p><div class="comments"><p>me too</p></div></article><aside>side</aside><footer>&copy; x</footer>'
    rows = [(1, "http://h.example/1", page), (2, None, None), (3, "nonsense", ""), (4, "http://h.example/2", "plain text & more"), (None, "http://h.example/3", page), (1, "http://h.example/1", page)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "Head & tail Onetwo three four"
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted([(1, text, len(text)), (1, text, len(text)), (0, text, len(text)), (2, "", 0), (3, "", 0), (4, "plain text & more", 17)])


def html_texts(spark, pages):
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages)
    return {r.page_id: r.text for r in got}


def test_html_template_without_article(spark):
    a = lambda i: f"<body><p>Site motto</p><div id=content><section id=intro><p>Intro {i}</p></section><section id=usage><p>Usage of thing {i}, longer</p></section></div><p>Site end</p></body>"
    b = lambda i: f"<body><div class=top>Motto</div><div class=text><p>Before {i}</p><ul>{''.join(f'<li>Long entry {i} {k}</li>' for k in range(i + 2))}</ul><p>After {i}</p>{'<table><tr><td>rare</td></tr></table>' if i == 3 else ''}</div></body>"
    pages = [(i, f"http://a.example/{i}", a(i)) for i in range(6)] + [(10 + i, f"http://b.example/{i}", b(i)) for i in range(6)]
    got = html_texts(spark, pages)
    for i in range(6):
        assert got[i] == f"Intro {i} Usage of thing {i}, longer"
        assert got[10 + i] == " ".join([f"Before {i}", *(f"Long entry {i} {k}" for k in range(i + 2)), f"After {i}"] + ["rare"] * (i == 3))


def test_html_copies_keep_their_text(spark):
    page = "<body><nav>menu</nav><article><h1>Title</h1><p>One text</p></article></body>"
    near = "<head><link href=x{}></head><body><nav>menu {}</nav><div><h1>Title</h1><p>One text</p></div></body>"
    other = "<body><article><p>Sign up</p><p>Text {}</p></article></body>"
    pages = [(i, f"http://a.example/?q={i}", page) for i in range(7)] + [(10 + i, None, page) for i in range(6)] + [(20 + i, f"http://b.example/{i}", near.format(i, i)) for i in range(6)]
    pages += [(30 + i, f"http://c.example/{i}", other.format(i)) for i in range(6)] + [(40 + i, f"http://c.example/c{i}", other.format(0)) for i in range(60)]
    got = html_texts(spark, pages)
    assert {got[i] for i in got if i < 30} == {"Title One text"}
    assert all(got[30 + i] == f"Text {i}" for i in range(6)) and all(got[40 + i] == "Text 0" for i in range(60))


def test_tool_calls(spark):
    call = '{"tool_calls":[{"id":"a","name":"reverse","arguments":{"lon":"2","lat":"1"}},{"id":"b","name":"reverse","arguments":{"lat":"north"}},{"id":"c","name":"fly","arguments":{}}]}'
    rows = [(1, 0, "user", "hello"), (1, 1, "tool", '{"tool_call_id":"a","content":"ok"}'), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id":"zz","content":"?"}'), (2, 0, None, None), (None, None, "user", "{broken")]
    got = tool_calls.link_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.call_id, r.status): r for r in got}
    assert {(r.call_id, r.status) for r in got} == {(None, "text"), ("a", "call"), ("a", "result"), ("b", "invalid: type of lat"), ("c", "invalid: unknown tool"), ("zz", "orphan")}
    assert len(got) == 8 - 0 and by["a", "call"].json == '{"arguments":{"lat":"1","lon":"2"},"id":"a","name":"reverse","role":"assistant"}'
    order = [(r.call_id, r.status) for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_depth, r.turn, r.order_item))]
    assert order == [(None, "text"), ("a", "call"), ("b", "invalid: type of lat"), ("c", "invalid: unknown tool"), ("a", "result"), ("zz", "orphan")]
    assert tool_calls.link_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_tool_calls_mixed_turns_and_types(spark):
    import json

    turns = [
        {"content": "Let me look", "tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "b", "function": {"name": "geocode", "arguments": '{"q": "Brno"}'}}]},
        {"tool_call_id": "a", "content": {"hits": [1, 2.5, None, True]}, "tool_calls": [{"id": "c", "name": "search", "arguments": {"query": 5}}, {"id": "d", "name": "search", "arguments": {"query": "x", "limit": "3"}}]},
        {"content": None, "tool_calls": [{"id": "e", "name": "reverse", "arguments": {"lon": 2, "lat": 1.5}}, {"id": "f", "name": "reverse", "arguments": {"lon": {"deg": [1]}, "lat": True}}, {"id": "g", "name": "search", "arguments": [1]}]},
    ]
    rows = [(1, i, "assistant", json.dumps(x)) for i, x in enumerate(turns)]
    got = tool_calls.link_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.turn, r.item): (r.call_id, r.status, json.loads(r.json)) for r in got}
    assert len(by) == len(got) == 9
    assert by[0, -1] == (None, "text", {"content": "Let me look", "role": "assistant"})
    assert by[0, 0] == ("a", "call", {"arguments": {"limit": 3, "query": "x"}, "id": "a", "name": "search", "role": "assistant"})
    assert by[0, 1] == ("b", "unanswered", {"arguments": {"q": "Brno"}, "id": "b", "name": "geocode", "role": "assistant"})
    assert by[1, -1] == ("a", "result", {"content": {"hits": [1, 2.5, None, True]}, "role": "assistant", "tool_call_id": "a"})
    assert [by[k][1] for k in [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]] == ["invalid: type of query", "invalid: type of limit", "unanswered", "invalid: type of lat", "invalid: arguments"]
    assert by[2, 1][2]["arguments"] == {"lat": True, "lon": {"deg": [1]}}


def test_pipeline(spark):
    import corpus_pipeline

    before = {r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, DIR).collect()
    assert out and {r.doc_id for r in out} <= before
    assert sorted(r.slot for r in out if r.shard == 0) == list(range(sum(r.shard == 0 for r in out)))
