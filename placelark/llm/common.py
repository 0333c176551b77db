"""Helpers that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset: the folder set on the context, or a local one if the driver is
    the only machine, as in tests; on a cluster it raises."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    d = os.path.join(tempfile.gettempdir(), "placelark-checkpoints")
    spark.sparkContext.setCheckpointDir(d)
    return d


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/placelark/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, t._stored_at)


def clean(spark: SparkSession) -> None:
    """Deletes all tables of `written` that this application still has: when its results have been stored."""
    _delete(spark, _own_dir(spark))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of so many rows while a job runs: both sides of the pipe to Python hold a whole batch of texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def values(batch, name: str):
    """Values of a column of an Arrow batch, one at a time: long texts aren't all held as Python strings."""
    return (x.as_py() for x in batch.column(name))


#: Bits of the filter that keeps rows that have no partner out of a join: ten an id, between these bounds (128 MB at most).
MIN_FILTER_LOG2, MAX_FILTER_LOG2 = 20, 30


def probably_in(ids: DataFrame, c: Column) -> Column:
    """Whether c may be in ids (_id): a Bloom filter sized by the number of ids and merged on the executors. Never false for a
    member; a full filter is always true, and the join behind it decides then."""
    spark = ids.sparkSession
    log2 = min(MAX_FILTER_LOG2, max(MIN_FILTER_LOG2, (ids.count() * 10).bit_length()))
    mask = (1 << log2) - 1
    at = lambda h: [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask).cast("long")) for k in (0, 17, 34)]
    bits = ids.select(F.explode(F.array(*at(F.xxhash64("_id")))).alias("p"))
    words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63L AS int))")).alias("b")).toPandas()
    own = np.zeros(1 << log2 - 6, np.int64)
    own[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(zlib.compress(own.tobytes(), 1))

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = np.frombuffer(zlib.decompress(shared.value), np.uint64)
        for h in batches:
            u, hit = h.to_numpy().view(np.uint64), True
            for k in (0, 17, 34):
                p = u >> np.uint64(k) & np.uint64(mask)
                hit = hit & ((words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)) == 1)
            yield pd.Series(hit)

    return test(F.xxhash64(c))


_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        m = max(n, 4096, 0 if got is None else 2 * len(got[0]))
        one = np.ones(m, np.uint64)
        one[1:] = np.uint64(base)
        inv = np.ones(m, np.uint64)
        inv[1:] = np.uint64(pow(base, -1, 2**64))
        got = (np.multiply.accumulate(one), np.multiply.accumulate(inv))
        if m <= 1 << 20:
            _powers[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bounds(norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text whose words are joined by single spaces."""
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(norm)]))


def window_hashes(norm: bytes, width: int, bases: tuple[int, ...] = BASES[:1]) -> list[np.ndarray]:
    """64-bit hashes of all runs of `width` words; `norm` has single spaces and at least `width` words."""
    s, e = word_bounds(norm)
    s, e = s[: len(s) - width + 1], e[width - 1 :]
    out = []
    for k, base in enumerate(bases):
        p, inv = _pow(base, len(norm) + 1)
        v = BYTE[np.frombuffer(norm, np.uint8)]
        v = mix(v) if k else v
        acc = np.zeros(len(norm) + 1, np.uint64)
        np.cumsum(v * p[: len(norm)], out=acc[1:])
        out.append(mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(base)))
    return out


#: Bytes of a part of a text: what is hashed at once, at some 60 bytes a byte, however long the text.
PART_BYTES = 1 << 19


def parts(norm: bytes, width: int, most: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(first window, bytes) of parts of a normed text, which overlap by a window less a word: each window is in one part."""
    most = most or PART_BYTES
    if len(norm) <= most:
        yield 0, norm
        return
    s, e = word_bounds(norm)
    n, a = len(s) - width + 1, 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(s, s[a] + most))))
        yield a, norm[s[a] : e[b + width - 2]]
        a = b
