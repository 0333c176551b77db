"""MinHash near-dedup with b-bit signatures.

1. A pass over the texts gives each document its set's size and 128-bit fingerprint, the band keys of its minima, and the
   minima's low bits, packed. Documents with equal sets are one class from here on; its smallest id stands for it.
2. Bands with two classes or more are grouped. Inside a group, similarity is estimated from equal low bits, corrected
   for chance collisions, and a spanning forest of what may be near (estimate within six deviations of the threshold) is kept.
3. The forests' components hold every link. Each is confirmed on full shingle sets, again as spanning forests.
   Both steps deal a group to blocks of bounded size, tie what they can to the group's center in one pass, and test only
   what stays loose against all blocks: no group's pairs are listed, and no reachability is lost.
4. Components of the confirmed links, by contraction over written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelark.llm.common import discard, mix, n_partitions, parts, probably_in, small_batches, table, values, window_hashes, written

BANDS, ROWS, BITS = 32, 5, 4
#: Signatures of a block of the estimating step, and shingles of a block of the confirming step.
GROUP = 500
BLOCK_SHINGLES = 50_000
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of the whole sequence if it has fewer words; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    return np.unique(np.concatenate([np.unique(window_hashes(part, width)[0]) for _, part in parts(b" ".join(words), width)]))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):  # a very long text in parts
        out = np.minimum(out, (s[i : i + 4096, None] * _A + _C).min(0))
    return mix(out)


def packed(m: np.ndarray) -> bytes:
    low = (m & np.uint64(15)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes()


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: the share of equal low bits, less what chance makes equal."""
    x = one ^ many
    x |= x >> 2 & 0x33
    x |= x >> 1
    unequal = _POP[x & 0x11].sum(-1)
    e, c = 1 - unequal / (BANDS * ROWS), 2.0**-BITS
    return (e - c) / (1 - c)


def forest(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of the graph whose links near(i, others) tells."""
    left, out = np.arange(n), []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = near(i, left)
            if hit.any():
                new = left[hit]
                out += [(i, int(j)) for j in new]
                stack += [int(j) for j in new]
                left = left[~hit]
    return out


def _signatures(width: int):
    def run(batches):
        for batch in batches:
            n, s1, s2, bands, sig = [], [], [], [], []
            for t in values(batch, "_t"):
                s = shingles(t, width)
                n.append(len(s))
                if not len(s):
                    s1.append(0), s2.append(0), bands.append(None), sig.append(None)
                    continue
                m = minima(s)
                band = np.zeros(BANDS, np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(31) + m[r::ROWS] + np.arange(BANDS, dtype=np.uint64))
                s1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                s2.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
                bands.append(band.view(np.int64))
                sig.append(packed(m))
            columns = pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], ["_id", "n", "s1", "s2", "bands", "sig"])

    return run


def by_estimate(margin: float):
    """near() over packed signatures."""

    def prepare(payload):
        sig = np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), -1)
        return lambda i, others: estimates(sig[i], sig[others]) >= margin

    return prepare


def by_sets(percent: int, width: int):
    """near() over whole texts: 100 * intersection >= percent * union of their full sets."""

    def prepare(payload):
        sets = [shingles(t, width) for t in payload]
        size = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(int(flat.max()) + 1, bool)

        def near(i, others):
            fit = (size[others] * 100 >= size[i] * percent) & (size[i] * 100 >= size[others] * percent)
            out = np.zeros(len(others), bool)
            if fit.any():
                own = flat[ends[i] : ends[i + 1]]
                mark[own] = True
                o = others[fit]
                lens = size[o]
                before = np.concatenate(([0], np.cumsum(lens)[:-1]))
                at = np.repeat(ends[o] - before, lens) + np.arange(lens.sum())
                inter = np.add.reduceat(mark[flat[at]].astype(np.int64), before)
                mark[own] = False
                out[fit] = inter * 100 >= percent * (size[i] + lens - inter)
            return out

        return near

    return prepare


def _groups(batches, keys: list[str]):
    """Tables of the groups of a partition sorted by its keys; a group may go over several batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if held and tuple(key[:, a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _members(t: pa.Table) -> tuple[np.ndarray, list]:
    """Ids and payloads of a group, each pair once, by id."""
    rows = sorted(set(zip(t["_id"].to_pylist(), t["_p"].to_pylist(), strict=True)))
    return np.array([x[0] for x in rows], np.int64), [x[1] for x in rows]


_EDGES = pa.schema([("g", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _edges(rows):
    g, a, b = zip(*rows, strict=True) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (g, a, b)], schema=_EDGES)


def _inside(prepare):
    """Forests of blocks; (g, member, null) for each member of a group of several blocks that its block's forest does not tie to the center."""

    def run(batches):
        out = []
        for t in _groups(batches, ["g", "x"]):
            ids, payload = _members(t)
            g, center, several = t["g"][0].as_py(), t["center"][0].as_py(), t["nb"][0].as_py() > 1
            if len(ids) > 1:
                got = forest(len(ids), prepare(payload))
                out += [(g, int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))) for i, j in got]
                if several:
                    root = np.arange(len(ids))  # a forest's links go from a tree's root outwards
                    for i, j in got:
                        root[j] = root[i]
                    at = int(np.searchsorted(ids, center))
                    out += [(g, int(ids[i]), None) for i in np.flatnonzero(root != root[at])]
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _across(prepare):
    """Forests of what members left alone and a block's members have in common: links of which one end at least was left."""

    def run(batches):
        out = []
        for t in _groups(batches, ["g", "x", "y"]):
            ids, payload = _members(t)
            left = np.isin(ids, t.filter(t["lone"])["_id"].to_numpy())
            near = prepare(payload)
            got = forest(len(ids), lambda i, others: near(i, others) & (left[i] | left[others]))
            out += [(t["g"][0].as_py(), int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))) for i, j in got]
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def spanned(members: DataFrame, payload: DataFrame, prepare, block: int, name: str) -> DataFrame:
    """(a, b): edges that connect, in each group g, the members that links near(..) of their payloads connect.

    members (g, _id, w, total: of w in the group, center: its smallest id), payload (_id, _p). A group is dealt to blocks of
    about `block`. First each block finds its forest, with the group's center in each block; where a group's members are
    mostly alike, that ties all of it in one pass over its rows. Only members not tied to the center then meet all blocks of
    their group, in chunks of the same size. No task holds more than two blocks, and no pair within a group is left
    untested but those that are tied already.
    """
    spark = members.sparkSession
    n = n_partitions(spark)
    chunks = lambda w: F.greatest(F.ceil(w / F.lit(block)), F.lit(1)).cast("int")
    m = members.withColumn("nb", chunks(F.col("total"))).withColumn("x", F.pmod(F.xxhash64(F.lit(5), "_id", "g"), "nb").cast("int"))
    seen = F.when((F.col("_id") == F.col("center")) & (F.col("nb") > 1), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("x"))
    held = m.join(payload, "_id").withColumn("x", F.explode(seen)).select("g", "x", "_id", "center", "nb", "_p")
    kind = "g long, a long, b long"
    with small_batches(spark):
        inside = written(held.repartition(n, "g", "x").sortWithinPartitions("g", "x").mapInArrow(_inside(prepare), kind), name)
    edges = inside.filter("b IS NOT NULL").select("a", "b")
    lone = inside.filter("b IS NULL").select("g", F.col("a").alias("_id"))
    if lone.isEmpty():
        return edges
    lone = lone.join(m.select("g", "_id", "w", "nb"), ["g", "_id"])
    count = lone.groupBy("g").agg(chunks(F.sum("w")).alias("nc"))
    lone = lone.join(count, "g").withColumn("y", F.pmod(F.xxhash64(F.lit(6), "_id", "g"), "nc").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("g", "x", "y", "_id", F.lit(True).alias("lone"))
    others = m.join(count, "g").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).select("g", "x", "y", "_id", F.lit(False).alias("lone"))
    pairs = lone.unionByName(others).join(payload, "_id")
    across = pairs.repartition(n, "g", "x", "y").sortWithinPartitions("g", "x", "y").mapInArrow(_across(prepare), kind)
    return edges.unionByName(across.select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the edges (a, b). Each round hooks every node below its
    smallest neighbour, follows parents to the end by doubling, and contracts; tables are written to the shared folder."""
    canon = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = written(canon(edges), "edges")
    label = written(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    while not e.isEmpty():
        up = written(e.groupBy("a").agg(F.min("b").alias("p")), "parents")
        while True:
            q = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            moved = written(up.select("a", "p").join(q, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("m")), "parents")
            discard(up)
            up = moved
            if moved.filter("m").isEmpty():
                break
        last, more = label, e
        parent = up.select("a", "p")
        label = written(label.join(parent.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        e = e.join(parent, "a").select(F.col("p").alias("a"), "b").join(parent.select(F.col("a").alias("b"), F.col("p").alias("p2")), "b", "left").select("a", F.coalesce("p2", "b").alias("b"))
        e = written(canon(e), "edges")
        discard(up, last, more)
    discard(e)
    return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of docs: (id, n_shingles, component_id, kept).

    A null or wordless text has no shingles and is alone. A row with a null id has its n_shingles, is linked with nothing, its
    component null, and is kept. Rows that repeat an id are one node and share its component. Copies of a class share the
    component of the smallest id. A very long text is hashed in parts. Bands miss a pair at the threshold with a probability
    under 1e-8; groups of any size are tested whole, in bounded blocks. Other columns are ignored. An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    with small_batches(docs.sparkSession):
        sigs = written(d.mapInArrow(_signatures(width), "_id long, n int, s1 long, s2 long, bands array<long>, sig binary"), "signatures")
    known = sigs.filter("n > 0 AND _id IS NOT NULL")
    reps = written(known.groupBy("s1", "s2", "n").agg(F.min("_id").alias("rep")), "classes")
    rep_sigs = written(known.join(reps.select(F.col("rep").alias("_id")).distinct(), "_id", "left_semi").select("_id", "bands", F.col("sig").alias("_p")), "representatives")
    keys = rep_sigs.select("_id", F.posexplode("bands").alias("band", "key")).select("_id", F.xxhash64("band", "key").alias("g"))
    shared = keys.groupBy("g").agg(F.count(F.lit(1)).alias("total"), F.min("_id").alias("center")).filter("total > 1")
    member = written(keys.join(shared, "g").withColumn("w", F.lit(1)), "members")
    sigma = (0.15 * 0.85 / (BANDS * ROWS)) ** 0.5 / (1 - 2.0**-BITS)
    margin = percent / 100 - 6 * max(sigma, 0.01)
    coarse = components(spanned(member, rep_sigs.select("_id", "_p"), by_estimate(margin), GROUP, "near"))
    widths = written(coarse.join(reps.groupBy("rep").agg(F.max("n").alias("w")).withColumnRenamed("rep", "node"), "node"), "coarse")
    sums = widths.groupBy("root").agg(F.sum("w").alias("total"))
    placed = written(widths.join(sums, "root").select(F.col("root").alias("g"), F.col("node").alias("_id"), "w", "total", F.col("root").alias("center")), "placed")
    discard(member, coarse, widths)
    texts = d.filter(F.col("_id").isNotNull() & probably_in(placed.select("_id"), F.col("_id"))).select("_id", F.col("_t").alias("_p"))
    label = components(spanned(placed, texts, by_sets(percent, width), BLOCK_SHINGLES, "exact")).withColumnRenamed("node", "rep")
    out = sigs.select("_id", F.col("n").cast("long").alias("n_shingles"), "n", "s1", "s2").join(reps, ["n", "s1", "s2"], "left")
    out = out.join(label, "rep", "left").select("_id", "n_shingles", F.when(F.col("_id").isNotNull(), F.coalesce("root", "rep", "_id")).alias("component_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest id; of rows that repeat an id and a text, one. Rows with a
    null id stay. Only rows that probably go are shuffled."""
    found = written(near_duplicates(docs.select(id_col, text_col), id_col, text_col, **kw).filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "verdict")
    doubt = found.filter("NOT kept OR n > 1").select("_id", "kept")
    key = F.col(f"`{id_col}`").cast("long")
    maybe = F.coalesce(probably_in(doubt.select("_id"), key), F.lit(False))
    row = docs.select(F.struct("*").alias("row"), key.alias("_id"), F.xxhash64(text_col).alias("_d"), maybe.alias("_maybe"))
    sure = row.filter("NOT _maybe OR _id IS NULL").select("row.*")
    tested = row.filter("_maybe AND _id IS NOT NULL").join(doubt, "_id", "left").filter("coalesce(kept, true)")
    first = tested.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_d").orderBy(F.lit(1)))).filter("_n = 1")
    return sure.unionByName(first.select("row.*"))


def op7_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.doc_id = d.doc_id"""
