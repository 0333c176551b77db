"""Substring dedup: a count-min prefilter, then exact grouping of the windows estimated repeated.

The sketch has two rows of counters. A window of 20 words is counted in row one by the 10-word run of the smallest hash
inside it, in row two by that of the largest: a run's count is never below that of a window it stands for, and one run
stands for six windows or so, so rows fill six times slower than by windows.

Pass one: each chunk of documents sketches its runs and ships the touched cells, saturated at two, as compressed gaps by
block of cells; blocks are merged by addition, in a stream. Pass two: windows whose cells count two or more in both rows
are resolved exactly by 128-bit fingerprints, first inside their chunk, so that a window costs a shuffled row only once a
chunk, then across chunks. The sketch never underestimates, so no repeat is lost; a full sketch only sends more windows to
the exact pass. Its size follows the input up to MAX_CELLS_LOG2.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelark.llm.common import BASES, discard, mix, n_partitions, parts, probably_in, small_batches, table, values, window_hashes, written
from placelark.llm.quality_rules import words_of

#: Cells of a row of the sketch: about one for each word, between these bounds; merged, a bit each on every worker
#: (128 MB a row at most). BLOCK_LOG2: cells of a block of it.
MIN_CELLS_LOG2, MAX_CELLS_LOG2, BLOCK_LOG2 = 22, 30, 18
#: Windows of a chunk: what a worker holds at once.
CHUNK_WINDOWS = 800_000
#: Rows of a batch that goes back to the JVM.
BATCH_ROWS = 100_000


def _normed(text: str | None) -> tuple[bytes, int]:
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    return b" ".join(words), len(words)


def _runs(norm: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of half a window, and for each window the first of the smallest and of the largest inside it."""
    half = (width + 1) // 2
    g = window_hashes(norm, half)[0]
    view = np.lib.stride_tricks.sliding_window_view(g, width - half + 1)
    i = np.arange(len(view))
    return g, i + view.argmin(1), i + view.argmax(1)


def _cells(g: np.ndarray, row: int, cells_log2: int) -> np.ndarray:
    """Cells of row 0, then those of row 1, in one range."""
    return (mix(g + np.uint64(row)) >> np.uint64(64 - cells_log2)).astype(np.int64) + (row << cells_log2)


def _sketch(cells_log2: int, width: int):
    def flush(cells: list[np.ndarray]):
        all_cells, counts = np.unique(np.concatenate(cells), return_counts=True)
        blocks = all_cells >> BLOCK_LOG2
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        out = []
        for own, n in zip(np.split(all_cells, cuts), np.split(counts, cuts), strict=True):
            gaps = np.diff(own, prepend=own[0] >> BLOCK_LOG2 << BLOCK_LOG2).astype(np.uint32)
            out.append((int(own[0] >> BLOCK_LOG2), zlib.compress(gaps.tobytes(), 1), zlib.compress(np.packbits(n > 1).tobytes(), 1), len(own)))
        blocks, gaps, twice, n = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(gaps, pa.binary()), pa.array(twice, pa.binary()), pa.array(n, pa.int32())], ["block", "gaps", "twice", "n"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for t in values(batch, "_t"):
                norm, k = _normed(t)
                if k < width:
                    continue
                for _, part in parts(norm, width):
                    g, low, high = _runs(part, width)
                    held.append(_cells(g[np.unique(low)], 0, cells_log2))
                    held.append(_cells(g[np.unique(high)], 1, cells_log2))
                    n += len(held[-1]) + len(held[-2])
                    if n >= CHUNK_WINDOWS:
                        yield flush(held)
                        held, n = [], 0
        if held:
            yield flush(held)

    return run


def _merge(batches):
    """Blocks' counters, saturated at two; one pass over the rows."""
    state: dict[int, np.ndarray] = {}
    for pdf in batches:
        for b, gaps, twice, n in zip(pdf["block"], pdf["gaps"], pdf["twice"], pdf["n"], strict=True):
            own = np.cumsum(np.frombuffer(zlib.decompress(gaps), np.uint32).astype(np.int64))
            c = state.setdefault(b, np.zeros(1 << BLOCK_LOG2, np.uint8))
            c[own] = np.minimum(2, c[own] + 1 + np.unpackbits(np.frombuffer(zlib.decompress(twice), np.uint8))[:n])
    for b, c in state.items():
        yield pd.DataFrame({"block": [b], "bits": [zlib.compress(np.packbits(c > 1).tobytes(), 1)]})


_FOUND = pa.schema([("_k", pa.int64()), ("_d", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("starts", pa.binary())])


def _candidates(bits, cells_log2: int, width: int):
    def rows(k, d, h1, h2, start, starts, n):
        null = lambda x, i: pa.nulls(n, _FOUND.types[i]) if x is None else pa.array(x, _FOUND.types[i])
        return pa.RecordBatch.from_arrays([null(x, i) for i, x in enumerate((k, d, h1, h2, start, starts))], schema=_FOUND)

    def flush(held):
        h1, h2 = (np.concatenate([x[k] for x in held]) for k in (2, 3))
        start = np.concatenate([x[4] for x in held])
        who = np.repeat(np.arange(len(held), dtype=np.int32), [len(x[2]) for x in held])
        ids, texts = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
        held.clear()
        order = np.lexsort((start, texts[who], ids[who], h2, h1))
        first = np.ones(len(order), bool)
        first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        w, v = who[order], who[lead]  # equal rows are one document: the same start of it is no repeat
        again = np.zeros(len(order), bool)
        again[order[(start[order] != start[lead]) | (ids[w] != ids[v]) | (texts[w] != texts[v])]] = True
        f = np.sort(order[first])  # by document: its columns compress
        del order, first, lead, w, v
        for a in range(0, len(f), BATCH_ROWS):
            own = f[a : a + BATCH_ROWS]
            yield rows(ids[who[own]], texts[who[own]], h1[own].view(np.int64), h2[own].view(np.int64), start[own], None, len(own))
        del h1, h2, f
        cut = np.flatnonzero(np.diff(who)) + 1
        local = [(ids[w[0]], texts[w[0]], s[a].astype(np.int32).tobytes()) for w, s, a in zip(np.split(who, cut), np.split(start, cut), np.split(again, cut), strict=True) if a.any()]
        if local:
            k, d, starts = zip(*local, strict=True)
            yield rows(k, d, None, None, None, starts, len(local))

    def run(batches):
        table_ = np.frombuffer(zlib.decompress(bits.value), np.uint8)
        held, n = [], 0
        for batch in batches:
            for k, d, t in zip(values(batch, "_k"), values(batch, "_d"), values(batch, "_t"), strict=True):
                norm, m = _normed(t)
                if m < width:
                    continue
                for first, part in parts(norm, width):
                    g, low, high = _runs(part, width)
                    hit = True
                    for row, own in ((0, low), (1, high)):
                        cell = _cells(g, row, cells_log2)
                        hit = hit & (table_[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)[own]
                    at = np.flatnonzero(hit)
                    if not len(at):
                        continue
                    h1, h2 = window_hashes(part, width, BASES)
                    held.append((k, d, h1[at], h2[at], (at + first).astype(np.int32)))
                    n += len(at)
                    if n >= CHUNK_WINDOWS:
                        yield from flush(held)
                        n = 0
        if held:
            yield from flush(held)

    return run


def _gaps(width: int):
    """What stays of a document between the windows that go: the first word and the number of words of each piece, to the document's end."""

    def one(starts, many):
        at = np.sort(np.concatenate([np.asarray(starts or (), np.int64), *(np.frombuffer(x, np.int32).astype(np.int64) for x in many or ())]))
        cut = np.flatnonzero(np.diff(at) > width)
        begin, end = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + width
        return (end - begin).sum(), np.concatenate(([0], end)), np.concatenate((begin[:1], begin[1:] - end[:-1], [2**31 - 1]))

    def run(batches):
        for batch in batches:
            gone, first, n = zip(*(one(*x) for x in zip(values(batch, "_starts"), values(batch, "_many"), strict=True)), strict=True) if batch.num_rows else [()] * 3
            columns = pa.array(gone, pa.int64()), pa.array(first, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_d"), *columns], ["_k", "_d", "_gone", "_first", "_n"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, cells_log2: int | None = None) -> DataFrame:
    """One row per row of docs: (id, n_words, n_removed, kept text, words joined by one space).

    A null text has no words; texts shorter than a window are kept; a very long one is hashed in parts. A document is a row's id
    and text: null ids come first, and rows of one id with different texts follow each other by a hash of the text. Equal
    rows are one document and cut alike. A window of a third of all documents is one row a chunk. Other columns are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_k"), F.xxhash64(text_col).alias("_d"), F.col(text_col).alias("_t"))
    n = n_partitions(spark)
    if cells_log2 is None:  # a word is six bytes or more, mostly
        size = d.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
        cells_log2 = min(MAX_CELLS_LOG2, max(MIN_CELLS_LOG2, (size // 6).bit_length()))
    cells_log2 = max(cells_log2, BLOCK_LOG2)
    sketched = d.select("_t").mapInArrow(_sketch(cells_log2, width), "block int, gaps binary, twice binary, n int")
    merged = sketched.repartition(n, "block").mapInPandas(_merge, "block int, bits binary")
    bits = np.zeros((2 << cells_log2 - BLOCK_LOG2, 1 << BLOCK_LOG2 - 3), np.uint8)
    with small_batches(spark):
        for b, x in merged.toLocalIterator():  # of bounded size, whatever the input
            bits[b] = np.frombuffer(zlib.decompress(bytes(x)), np.uint8)
    shared = spark.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))
    del bits
    with small_batches(spark):
        found = written(d.select("_k", "_d", "_t").mapInArrow(_candidates(shared, cells_log2, width), "_k long, _d long, h1 long, h2 long, start int, starts binary"), "windows")
    order = Window.partitionBy("h1", "h2").orderBy("_k", "_d", "start")
    later = found.filter("starts IS NULL").select("_k", "_d", "h1", "h2", "start").withColumn("_rank", F.rank().over(order)).filter("_rank > 1").select("_k", "_d", "start")
    pieces = later.select("_k", "_d", "start", F.lit(None).cast("binary").alias("starts")).unionByName(found.filter("starts IS NOT NULL").select("_k", "_d", F.lit(None).cast("int").alias("start"), "starts"))
    starts = pieces.groupBy("_k", "_d").agg(F.collect_list("start").alias("_starts"), F.collect_list("starts").alias("_many"))
    with small_batches(spark):
        repeats = written(starts.mapInArrow(_gaps(width), "_k long, _d long, _gone long, _first array<int>, _n array<int>"), "repeats")
    discard(found)
    # only texts that lose words meet their gaps: the others aren't shuffled; texts don't go to Python again
    marked = d.withColumn("_in", probably_in(repeats.select(F.xxhash64("_k", "_d").alias("_id")), F.xxhash64("_k", "_d")))
    cut = marked.filter("_in").join(repeats, ["_k", "_d"], "left").select("_id", "_t", "_gone", "_first", "_n")
    none = F.lit(None).cast("array<int>")
    whole = marked.filter("NOT _in").select("_id", "_t", F.lit(None).cast("long").alias("_gone"), none.alias("_first"), none.alias("_n"))
    out = cut.unionByName(whole).withColumn("_w", words_of(F.col("_t")))
    stay = F.flatten(F.zip_with("_first", "_n", lambda first, n: F.slice(F.col("_w"), first + 1, F.least(n, F.size("_w")))))
    kept = F.array_join(F.when(F.col("_first").isNull(), F.col("_w")).otherwise(stay), " ")
    out = out.select("_id", F.size("_w").cast("long").alias("n_words"), F.coalesce("_gone", F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))
    return out.withColumnRenamed("_id", id_col)


def op6_substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
s AS (SELECT doc_id, pos, string_agg(word, ' ') OVER f AS words, count(*) OVER f AS n FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) AS nth FROM s WHERE n = 20),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 19)) AS pos FROM r WHERE nth > 1),
k AS (SELECT doc_id, count(*) FILTER (WHERE g.pos IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE g.pos IS NULL) AS kept FROM p LEFT JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
