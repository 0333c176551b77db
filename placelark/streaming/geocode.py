"""Streams of queries: stateless scoring against the static index, and a debounce of keystrokes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelark.functions.text import fold


def lookup(stream: DataFrame, anchors: DataFrame) -> DataFrame:
    """Query rows (query_id, q) joined to the anchors of exactly that folded name: a stream-static join without state."""
    a = anchors.select(fold(F.col("name")).alias("k"), "anchor_id", "name", "country")
    return stream.withColumn("k", fold(F.col("q"))).join(a, "k")


def debounce(stream: DataFrame, gap: str = "150 milliseconds", late: str = "1 second") -> DataFrame:
    """Keystrokes (user, q, ts): the last text of each session of a user, sessions ending after the gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user").agg(F.max_by("q", "ts").alias("q")).select("user", "q", F.col("w.end").alias("at"))


def answers(stream: DataFrame, geocoder, path: str, checkpoint: str, limit: int = 10):
    """Starts a query that answers a stream of texts (query_id, q; country, lat, lon if there) with the whole of the engine, a micro-batch at a time, into
    Parquet under path: readings, scores, house numbers, corrections. A batch is written under its number, so one that runs again
    replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        geocoder.forward(batch, limit=limit).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
