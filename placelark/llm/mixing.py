"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block quotas.

Each source's documents fall into blocks by a seeded hash. The blocks are permuted, and drawn pass after pass until the
source's target of words is taken; of the last block, whole documents are drawn in permuted order while they fit, and a few
documents, some of them twice if the cap lets them, fill what is left. The tree then halves the output shards again and again, and draws how many of each
source's draws go left, so each shard holds an exact, disjoint quota of every source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelark.llm.common import table, written
from placelark.llm.quality_rules import words_of

#: Sources that the driver may plan for; beyond it the operator refuses, before it collects anything.
MAX_SOURCES = 65_536
#: Blocks of a source, however large it is, and of all sources together: what the driver holds and broadcasts, a row a block.
BLOCKS, ALL_BLOCKS = 256, 1 << 20
#: So many words of a source's target are left to single documents, chosen so that their sum comes nearest.
TAIL_WORDS, EXACT_WORDS = 4096, 65536


def targets(sizes: list[float], weights: list[float], cap: float) -> list[float]:
    """Shares of the total by weight, none above cap times its size; the excess is shared again by weight."""
    total, fixed, out = float(sum(sizes)), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, w = total - sum(cap * sizes[i] for i in fixed), sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in range(len(sizes)):
                out[i] = float(cap * sizes[i]) if i in fixed else left * weights[i] / w
            return out
        fixed |= set(over)


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas (sources) dealt to shards: an array shards x sources whose columns add up to the quotas, and whose rows
    add up to sums at most one apart."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def go(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid, total = (lo + hi) // 2, int(q.sum())
        n = total * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, n, method="marginals") if total else q
        go(lo, mid, left)
        go(mid, hi, q - left)

    if len(quotas):
        go(0, shards, quotas)
    return out


def fill(left: float, spare: list[tuple[int, int]]) -> list[int]:
    """Keys of the (words, key) whose sum comes nearest to `left`; the largest go first while it is above EXACT_WORDS."""
    out, rest = [], []
    for n, h in sorted(spare, reverse=True):
        if left > EXACT_WORDS and n <= left:
            out.append(h)
            left -= n
        else:
            rest.append((n, h))
    goal = round(left)
    mask, sums = (1 << 2 * min(goal, EXACT_WORDS) + 1) - 1, [1]  # sums[k]: bit n is set if some of the first k add up to n
    for n, _ in rest:
        sums.append((sums[-1] | sums[-1] << n) & mask)
    at = min((x for d in range(goal + 1) for x in (goal - d, goal + d) if sums[-1] >> x & 1), key=lambda x: abs(x - left), default=0) if goal <= EXACT_WORDS and sums[-1] >> 1 else 0
    for k in range(len(rest), 0, -1):
        if not sums[k - 1] >> at & 1:
            out.append(rest[k - 1][1])
            at -= rest[k - 1][0]
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), cap: int = 3, shards: int = 16, seed: int = 29, blocks: int = BLOCKS) -> DataFrame:
    """docs with size, source_size, target, taken, passes (whole draws), part (further draws, two at most), mix_shard (of the first
    draw), mix_shards (of each draw) and mix_order.

    Sources go by code point, null last. Word counts alone are summed, by source and block, combined map-side: a source
    with a third of all rows is `blocks` rows a task. A document without words has taken 0. Blocks follow from the id and
    the source (null ids hash like any), so reruns agree; rows of one id and source are drawn together. Texts are not shuffled: the
    plan is broadcast, ALL_BLOCKS rows at most, as many sources have fewer blocks each; the operator refuses beyond MAX_SOURCES
    sources. mix_order is a seeded hash: sorting by it is a shuffle. A very long text is counted whole. An empty table gives no
    rows. Columns of docs named like a result are replaced.
    """
    docs = docs.drop(*[c for c in ("size", "source_size", "target", "taken", "passes", "part", "mix_shard", "mix_shards", "mix_order", "_block", "_no") if c not in (id_col, text_col, source_col)])
    spark = docs.sparkSession
    sources = docs.select(source_col).distinct().count()
    if sources > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    blocks = max(1, min(blocks, ALL_BLOCKS // max(1, sources)))
    sized = docs.withColumn("size", F.size(words_of(F.col(text_col))).cast("long")).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col)), F.lit(blocks)).cast("int")).withColumn("mix_order", F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(source_col)))
    units = written(sized.select(F.col(source_col).alias("_s"), "_block", "mix_order", "size").groupBy("_s", "_block", "mix_order").agg(F.sum("size").alias("size")), "units")
    got = units.groupBy("_s", "_block").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("n")).collect()  # ALL_BLOCKS rows at most
    names = sorted({r[0] for r in got if r[0] is not None}) + [None] * any(r[0] is None for r in got)
    words, count = np.zeros((len(names), blocks), np.int64), [0] * len(names)
    at = {s: i for i, s in enumerate(names)}
    for s, b, n, k in got:
        words[at[s], b] = n
        count[at[s]] += k
    size = [int(x) for x in words.sum(1)]
    goal = targets(size, [weights[i % len(weights)] for i in range(len(names))], cap) if sum(size) else [0.0] * len(names)
    draws, whole, last = [], [], {}
    for i in range(len(names)):
        order = [int(b) for b in np.random.default_rng([seed, i]).permutation(blocks) if words[i, b]]
        passes = int(goal[i] // size[i]) if size[i] else 0
        left, once_more = goal[i] - passes * size[i], []
        for b in order:  # a block that a long document makes too large is passed over
            if left <= max(size[i] / len(order), TAIL_WORDS):
                break
            if words[i, b] <= left:
                once_more.append(b)
                left -= int(words[i, b])
        spare = [b for b in order if b not in set(once_more)]
        if left >= 0.5 and spare:
            last[i] = (spare[0], float(left), 4.0 * size[i] / count[i])
        draws.append(order * passes + once_more + ([last[i][0]] if i in last else []))
        whole.append((passes, set(once_more)))
    dealt = split_tree(np.array([len(x) for x in draws], np.int64), shards, seed)
    rows, last_shard = [], {}
    for i, own in enumerate(draws):
        by_block: dict[int, list[int]] = {}
        for b, k in zip(own, np.repeat(np.arange(shards), dealt[:, i]), strict=True):
            by_block.setdefault(b, []).append(int(k))
        if i in last:
            last_shard[i] = by_block[last[i][0]].pop()
        rows += [(names[i], b, whole[i][0], int(b in whole[i][1]), ks) for b, ks in by_block.items()]
    plan = spark.createDataFrame(rows, "_source string, _pblock int, passes int, _once int, _shards array<int>")
    # of the last block, in order while they fit
    ends = F.broadcast(spark.createDataFrame([(names[i], *x) for i, x in last.items()], "_source string, _lblock int, _left double, _long double"))
    ahead = units.join(ends, F.col("_s").eqNullSafe(F.col("_source")))
    run = F.sum("size").over(Window.partitionBy("_s").orderBy("mix_order").rowsBetween(Window.unboundedPreceding, 0))
    fits = ahead.filter("_block = _lblock AND size <= _long").withColumn("_run", run).filter(F.col("_run") <= F.col("_left") - TAIL_WORDS).groupBy("_s").agg(F.max("mix_order").alias("h"), F.max("_run").alias("n")).collect()
    upto = {at[r[0]]: (r[1], r[2]) for r in fits}
    # a few documents of each size that are not drawn once more
    edge = F.broadcast(spark.createDataFrame([(names[i], upto.get(i, (None, 0))[0], x - upto.get(i, (None, 0))[1]) for i, (_, x, _) in last.items()], "_s2 string, _upto long, _rest double"))
    spare = ahead.join(edge, F.col("_s").eqNullSafe(F.col("_s2"))).filter("size > 0 AND size <= 2 * _rest AND NOT (_block = _lblock AND size <= _long AND coalesce(mix_order <= _upto, false))")
    spare = spare.join(F.broadcast(plan.select(F.col("_source").alias("_s3"), "_pblock", "_once")), F.col("_s").eqNullSafe(F.col("_s3")) & (F.col("_block") == F.col("_pblock")), "left").filter("coalesce(_once, 0) = 0")
    found = spare.groupBy("_s", F.floor(4 * F.log2("size")).alias("_size"), F.pmod("mix_order", F.lit(8)).alias("_k")).agg(F.min(F.struct("mix_order", "size")).alias("u")).select("_s", "u.size", "u.mix_order").collect()
    spares: dict[int, list[tuple[int, int]]] = {}
    for s, n, h in found:
        spares.setdefault(at[s], []).extend([(n, h)] * max(1, min(2, cap - whole[at[s]][0])))
    fills = {i: fill(x - upto.get(i, (None, 0))[1], spares.get(i, [])) for i, (_, x, _) in last.items()}
    by_source = spark.createDataFrame([(n, size[i], goal[i], *(last[i][::2] if i in last else (None, None)), upto.get(i, (None,))[0], fills.get(i, []), last_shard.get(i)) for i, n in enumerate(names)], "_s2 string, source_size long, target double, _lblock int, _long double, _upto long, _fills array<long>, _lshard int")
    out = sized.join(F.broadcast(plan), F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_pblock")), "left")
    out = out.join(F.broadcast(by_source), F.col(source_col).eqNullSafe(F.col("_s2")), "left")
    ahead = (F.col("_block") == F.col("_lblock")) & (F.col("size") <= F.col("_long")) & (F.col("mix_order") <= F.col("_upto"))
    more = F.when(ahead, 1).otherwise(0) + F.size(F.filter("_fills", lambda h: h == F.col("mix_order")))
    none = F.array().cast("array<int>")
    return (
        out.withColumn("passes", F.coalesce("passes", F.lit(0))).withColumn("part", (F.coalesce("_once", F.lit(0)) + more).cast("double"))
        .withColumn("taken", (F.col("size") * (F.col("passes") + F.col("part"))).cast("long"))
        .withColumn("mix_shards", F.when(F.col("size") > 0, F.concat(F.coalesce("_shards", none), F.when(more > 0, F.array_repeat("_lshard", more)).otherwise(none))).otherwise(none))
        .withColumn("mix_shard", F.get("mix_shards", 0))
        .drop("_source", "_pblock", "_once", "_shards", "_block", "_s2", "_lblock", "_long", "_upto", "_fills", "_lshard")
    )


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document once a draw, in the draw's shard (mix_shard) and there in the order of mix_order, which differs by
    draw. A shard is spread over partitions by its order, so it needs no task of its own."""
    out = mixed.select("*", F.posexplode("mix_shards").alias("_draw", "_shard"))
    out = out.withColumn("mix_shard", F.col("_shard")).withColumn("mix_order", F.xxhash64("mix_order", "_draw"))
    return out.repartition("mix_shard", F.pmod("mix_order", F.lit(64))).sortWithinPartitions("mix_shard", "mix_order").select(*columns)


def op10_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "mix_shard", "mix_order")
