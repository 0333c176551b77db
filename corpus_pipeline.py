"""A corpus from raw documents: quality rules, near-duplicates, benchmark passages, source weights, shards.

Every stage judges whole texts of all rows that it is given, and takes nulls in any column, empty and very long texts, repeated rows and
empty tables. Rows travel whole, as one struct where an operator adds columns of its own, so that columns of documents with the
name of such a column come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from placelark.llm.common import table, written
from placelark.llm.decontamination import decontaminate
from placelark.llm.mixing import materialise, mix
from placelark.llm.near_dedup import keep_one
from placelark.llm.quality_rules import verdicts
from placelark.llm.sharding import shuffle_shards


def quality(spark, docs, sf_dir):
    """Documents that no rule rejects, base rules among them. A null or empty text is too short and goes; rows are judged one by one, so
    repeated rows and null ids share the fate of their text."""
    return verdicts(docs.select(F.struct("*").alias("row"), "text")).filter("kept").select("row.*")


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies, that of the smallest id, and one of rows that repeat an id and a text. Null and wordless
    texts are near to nothing and stay, as do rows with a null id."""
    return keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without a benchmark item, up to its edits. Null and empty texts stay, null and empty items are in no document."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """Documents as often as the mix takes them, three times at most; a document without words is not taken. A null source is a source."""
    mixed = mix(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source"))
    return materialise(mixed, ["row"]).select("row.*")


def sharding(spark, docs, sf_dir):
    """Documents with shard and slot, which replace columns of these names."""
    return shuffle_shards(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: Edit distance inside texts and seeded draws have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
