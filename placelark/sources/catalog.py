"""The catalogue of country extracts: tab-separated countries and groups, and selections of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES, GROUPS = "code string, path string, size bigint, name string", "name string, members string"


def load(spark: SparkSession, countries: str, groups: str) -> tuple[DataFrame, DataFrame]:
    read = lambda path, schema: spark.read.csv(path, sep="\t", comment="#", schema=schema, mode="FAILFAST")
    return read(countries, COUNTRIES), read(groups, GROUPS)


def resolve(selection: str, countries: DataFrame, groups: DataFrame) -> DataFrame:
    """(pos, code, path, size, name) of codes and `@groups`, in order, each once. Unknown names and empty selections raise."""
    spark = countries.sparkSession
    items = [(i, x.strip().lower()) for i, x in enumerate(selection.split(",")) if x.strip()]
    if not items:
        raise ValueError("empty selection")
    asked = spark.createDataFrame(items, "i int, item string")
    g = groups.select(F.concat(F.lit("@"), "name").alias("item"), F.posexplode(F.split("members", ",")).alias("j", "code")).withColumn("code", F.trim("code"))
    each = asked.filter("item LIKE '@%'").join(g, "item", "left").unionByName(asked.filter("item NOT LIKE '@%'").withColumn("j", F.lit(0)).withColumn("code", F.col("item")))
    first = each.groupBy("code").agg(F.min(F.struct("i", "j")).alias("pos"), F.min("item").alias("item"))
    out = first.join(countries, "code", "left")
    bad = [r.item for r in out.filter("path IS NULL").limit(5).collect()]
    if bad:
        raise ValueError(f"unknown: {', '.join(sorted(bad))}")
    return out.orderBy("pos").select("pos", "code", "path", "size", "name")


def file_name(path):
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit("-latest.osm.pbf"))


def url(base: str, path):
    return F.concat(F.lit(base.rstrip("/") + "/"), path, F.lit("-latest.osm.pbf"))
