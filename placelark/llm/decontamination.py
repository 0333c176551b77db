"""Benchmark decontamination: pigeonhole edit matching, verified by Myers' bit-parallel distance."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelark.llm.common import table, values

#: Bytes of benchmark texts that one block of patterns may hold: what is broadcast, whatever the table's size.
BLOCK_BYTES = 16 << 20
#: A code point in so many may differ.
PER_EDIT = 16


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 disjoint pieces that cover the item; a match with at most `budget` edits leaves one of them exact."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


#: Letters of scripts that put no space between words.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def boundary(text: str, at: int) -> bool:
    """Whether a word may end or begin at `at`: not between two letters or digits, unless one is of an unspaced script."""
    if not 0 < at < len(text):
        return True
    a, b = text[at - 1], text[at]
    return not (a.isalnum() and b.isalnum()) or bool(UNSPACED.match(a) or UNSPACED.match(b))


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of pattern inside text, the first of equals; None above `most`. Bit-parallel over
    the pattern's positions."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def searcher(rows: list[tuple[int, str, int]], min_chars: int):
    """A function from a text to (item, distance, end, length) of the best match of each item (id, normal text, budget) that it holds."""
    machine = ahocorasick.Automaton()
    at: dict[str, list] = {}
    for i, (_, text, k) in enumerate(rows):
        for a, p in pieces(text, k):
            at.setdefault(p, []).append((i, a))
    for p, where in at.items():
        machine.add_word(p, (len(p), where))
    machine.make_automaton()

    def search(raw: str | None) -> list[tuple[int, int, int, int]]:
        text = normal(raw)
        tried: dict[int, list[int]] = {}
        short: dict[int, int] = {}
        for end, (n, where) in machine.iter(text):
            for i, a in where:
                if len(rows[i][1]) < min_chars:
                    if i not in short and boundary(text, end + 1 - n) and boundary(text, end + 1):
                        short[i] = end + 1
                    continue
                tried.setdefault(i, []).append(end + 1 - n - a)
        out = [(rows[i][0], 0, end, len(rows[i][1])) for i, end in short.items()]
        for i, starts in tried.items():
            item, pattern, k = rows[i]
            j, best = text.find(pattern), None
            if j >= 0:
                best = (0, j + len(pattern))
            else:
                spans: list[list[int]] = []
                for s in sorted(starts):  # overlapping windows are searched once
                    lo, hi = max(0, s - k), min(len(text), s + len(pattern) + k)
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(hi, spans[-1][1])
                    else:
                        spans.append([lo, hi])
                for lo, hi in spans:
                    got = myers(pattern, text[lo:hi], k)
                    if got and (best is None or got[0] < best[0]):
                        best = (got[0], lo + got[1])
            if best:
                out.append((item, *best, len(pattern)))
        return out

    return search


def item_blocks(items: DataFrame, item_col: str, item_text_col: str, per_edit: int, min_chars: int):
    """Broadcast lists of (id, normal text, budget), of BLOCK_BYTES each, read one after another."""
    spark, block, held = items.sparkSession, [], 0
    for i, t in items.select(F.col(item_col).cast("long"), F.col(item_text_col)).filter(F.col(item_text_col).isNotNull()).toLocalIterator():
        t = normal(t)
        if not t:
            continue
        block.append((i, t, len(t) // per_edit if len(t) >= min_chars else 0))
        held += max(len(t), min_chars)  # a row costs as much, however short
        if held >= BLOCK_BYTES:
            yield spark.sparkContext.broadcast(block)
            block, held = [], 0
    if block:
        yield spark.sparkContext.broadcast(block)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", per_edit: int = PER_EDIT, min_chars: int = 40) -> DataFrame:
    """(id, item_id, distance, end_char, item_chars): the best match of each item in each document, within len / per_edit edits.

    Texts are compared in lower case with runs of white space as one space. Items are read in blocks of BLOCK_BYTES, each
    block against all documents, map-only: nothing is shuffled and no document meets another. Items under `min_chars`
    code points are matched without edits, from one word boundary to another. Null or empty items match nothing; null
    texts hold nothing; a null id is reported as null; a very long text is searched whole, alone. Rows that repeat give rows that
    repeat. Other columns are ignored. An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    schema = "_id long, item_id long, distance int, end_char int, item_chars int"
    out = docs.sparkSession.createDataFrame([], schema)

    def found(block):
        def run(batches):
            search = searcher(block.value, min_chars)
            for batch in batches:
                rows = [(n, *hit) for n, t in enumerate(values(batch, "_t")) for hit in search(t)]
                at, *columns = zip(*rows, strict=True) if rows else [()] * 5
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["_id", "item_id", "distance", "end_char", "item_chars"])

        return run

    for block in item_blocks(items, item_col, item_text_col, per_edit, min_chars):
        out = out.unionByName(d.mapInArrow(found(block), schema))
    return out.withColumnRenamed("_id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", per_edit: int = PER_EDIT, min_chars: int = 40) -> DataFrame:
    """docs without those that hold an item, as find_leaks finds it. Map-only: each row is judged by its own text, so ids may be null or
    repeat, and rows go through whole, whatever their other columns. A null text stays; an empty table gives no rows."""

    def clean(block):
        def run(batches):
            search = searcher(block.value, min_chars)
            for batch in batches:
                yield batch.filter(pa.array([not search(t) for t in values(batch, text_col)], pa.bool_()))

        return run

    for block in item_blocks(items, item_col, item_text_col, per_edit, min_chars):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs


def op5_decontaminate(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
