"""Sharding: two-pass external shuffle.

Pass one scatters records uniformly, by a seeded hash, into buckets that fit in memory. Pass two sorts each bucket to a
fixed order, permutes it by Fisher-Yates under a generator seeded by the bucket, and deals it to shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelark.llm.common import table


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of range(n): numpy's shuffle swaps each place, from the last, with a random one not after it."""
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)
    return order


def shuffle_shards(docs: DataFrame, shards: int = 8, seed: int = 17, text_col: str = "text", bucket_bytes: int = 32 << 20) -> DataFrame:
    """docs with `shard` and `slot` (gapless from 0 in each shard); counts of shards are at most one apart.

    Buckets follow from a hash of all columns, so equal rows alone share one: the size of a bucket is about
    `bucket_bytes`, or that of its one text where that is longer. Positions are global: a bucket starts where those before it end, 16 bytes a
    bucket on the driver. Reruns and recomputed tasks agree, as each bucket is sorted before its seeded shuffle; equal rows
    are interchangeable. Rows stay in Arrow, so nulls change no value beside them. Nulls hash like any value, null and empty
    texts count a byte; an empty table gives no rows. Columns named `_bucket`, `_hash`, `shard` or `slot` in docs are replaced.
    """
    docs = docs.drop("shard", "slot", "_bucket", "_hash")
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    hashed = docs.withColumn("_hash", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]))
    total = docs.agg(F.sum(size)).first()[0] or 0
    n = max(1, math.ceil(total / bucket_bytes))
    bucketed = hashed.withColumn("_bucket", F.pmod("_hash", F.lit(n)).cast("int"))
    counted = bucketed.groupBy("_bucket").count().toArrow()
    counts = np.zeros(n, np.int64)
    counts[counted["_bucket"].to_numpy()] = counted["count"].to_numpy()
    starts = spark.sparkContext.broadcast(np.concatenate(([0], np.cumsum(counts))))
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def deal(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        b = key[0].as_py()
        order = np.argsort(rows["_hash"].to_numpy(), kind="stable")[fisher_yates(rows.num_rows, [seed, b])]
        rows = rows.drop_columns(["_bucket", "_hash"]).take(pa.array(order))
        at = starts.value[b] + np.arange(rows.num_rows)
        return rows.append_column("shard", pa.array((at % shards).astype(np.int32))).append_column("slot", pa.array(at // shards))

    return bucketed.groupBy("_bucket").applyInArrow(deal, schema)


def write_shards(docs: DataFrame, path: str, **kw) -> None:
    """Writes the shards under path/shard=K. Each task writes the buckets that it dealt, a file a shard, in the order of their slots:
    no task holds a whole shard."""
    shuffle_shards(docs, **kw).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_shard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    t = F.coalesce("text", F.lit(""))
    return shuffle_shards(docs).select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
