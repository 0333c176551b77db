"""Line dedup: explode normalised lines, hash, count documents per hash, drop lines over a threshold, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelark.llm.common import WS, ascii_lower, table, written


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


#: A key with more than this share of all lines goes by broadcast: there are fewer such keys than its inverse, whatever the input.
HOT_SHARE = 1e-4


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row per row of docs: (id, n_lines, n_dropped, kept).

    Lines whose key has `min_chars` code points and is in `min_docs` documents go everywhere but in the smallest id.
    Two 64-bit hashes a line are shuffled for the counts, combined map-side. The keys found meet the lines again: frequent
    ones, 1 / HOT_SHARE at most, by broadcast, so that a line of a third of all documents fills no task; the others in a
    shuffled join. A null text is one empty line; a null id counts as the smallest id. Rows that repeat an id are one
    document, and each is cut by its own text: equal rows alike. Texts are split inside the plan, one at a time, however
    long. Other columns of docs are ignored. An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_d", F.xxhash64("_t"))
    split = lambda c: F.split(c, "\n", -1)
    lines = d.select("_k", "_d", F.posexplode(split(F.col("_t"))).alias("_pos", "_line")).select("_k", "_d", "_pos", line_key(F.col("_line")).alias("_key"))
    lines = lines.filter(F.char_length("_key") >= min_chars).select("_k", "_d", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2"))
    if min_docs > 2:
        held = lines.groupBy("_k", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
        common = held.groupBy("_h1", "_h2").agg(F.min("_k").alias("_first"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_docs")).filter(F.col("_docs") >= min_docs)
    else:  # two documents hold it if the smallest and the largest id differ: nothing but numbers a hash to combine
        common = lines.groupBy("_h1", "_h2").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_first < _last")
    common = written(common.select("_h1", "_h2", "_first", "_n"), "lines")
    least = (common.agg(F.sum("_n")).first()[0] or 0) * HOT_SHARE
    hot = common.filter(F.col("_n") > least).select(F.col("_h1").alias("_a"), F.col("_h2").alias("_b"), F.col("_first").alias("_hot"))
    met = lines.join(F.broadcast(hot), (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")), "left")
    # frequent lines go through the same join, so that lines are split twice, not three times: each by a key of its own, which spreads them
    spread = F.when(F.col("_hot").isNotNull(), F.xxhash64("_k", "_d", "_pos", "_h2")).otherwise(F.col("_h1"))
    met = met.select("_k", "_d", "_pos", "_hot", spread.alias("_h1"), "_h2").join(common.filter(F.col("_n") <= least).select("_h1", "_h2", "_first"), ["_h1", "_h2"], "left")
    drop = met.filter(F.col("_k") > F.coalesce("_hot", "_first")).groupBy("_k", "_d").agg(F.collect_set("_pos").alias("_drop"))
    got = d.join(drop, ["_k", "_d"], "left").withColumn("_lines", F.when(F.col("_drop").isNotNull(), split(F.col("_t"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    kept = F.when(F.col("_drop").isNull(), F.col("_t")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    return got.select(
        F.col("_id").alias(id_col),
        (F.char_length("_t") - F.char_length(F.replace("_t", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def op4_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, c.first IS NOT NULL AND k.doc_id <> c.first AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
