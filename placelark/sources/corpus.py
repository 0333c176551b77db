"""The driver's tables as a synthetic gazetteer: anchors, addresses, shapes and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
PLACE_CLASSES = "city town village hamlet suburb quarter neighbourhood borough isolated_dwelling municipality".split()
CATEGORIES = ["amenity=restaurant", "railway=station", "tourism=museum", "shop=supermarket", "natural=peak", "amenity=school", "tourism=hotel"]


def _at(id_col: str, a: int, base: int):
    return F.lit(base) + (F.col(id_col) * a % 10000) / 10000


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    # the match ends with the fourth word: the rest of a text isn't scanned
    head = F.regexp_extract(F.coalesce("text", F.lit("")), "(?:\\p{L}+\\P{L}+){0,3}\\p{L}+", 0)
    d = d.withColumn("w", F.regexp_extract_all(head, F.lit("\\p{L}+"), F.lit(0))).drop("text")
    pick = lambda values, c: F.get(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values)).cast("int"))
    return d.select(
        F.col("doc_id").alias("anchor_id"),
        (F.col("doc_id") % 3).cast("int").alias("layer"),
        F.col("lang").alias("country"),
        F.concat_ws(" ", F.get("w", 0), F.get("w", 1)).alias("name"),
        F.coalesce(F.get("w", 2), F.lit("")).alias("locality"),
        F.coalesce(F.get("w", 3), F.lit("")).alias("alias"),
        F.col("n_chars").alias("population"),
        pick(PLACE_CLASSES, "doc_id").alias("place_type"),
        pick(CATEGORIES, "doc_id").alias("category"),
        _at("doc_id", 7919, 47).alias("lat"),
        _at("doc_id", 104729, 9).alias("lon"),
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.count(F.lit(1)).alias("n"))
    a, b = F.col("o_orderkey") % 97 + 1, F.col("o_orderkey") % 31 + 1
    s = lambda c: c.cast("string")
    number = F.when(F.col("o_orderkey") % 6 == 0, s(a)).when(F.col("o_orderkey") % 6 == 1, F.concat(s(a), F.lit("/"), s(b))).when(F.col("o_orderkey") % 6 == 2, F.concat(s(a), F.lit("A")))
    number = number.when(F.col("o_orderkey") % 6 == 3, F.concat(F.lit("ev."), s(a))).when(F.col("o_orderkey") % 6 == 4, F.concat(s(a), F.lit("-"), s(b))).otherwise(F.concat(s(a), F.lit(" b")))
    out = o.join(F.broadcast(n)).select(F.col("o_orderkey").alias("address_id"), (F.col("o_custkey") % F.col("n")).alias("anchor_id"), number.alias("house_number"))  # n is one row
    return out.select(
        "*", (F.lit(47) + (F.col("anchor_id") * 7919 % 10000) / 10000 + ((F.col("address_id") * 31 % 200) - 100) / 100000).alias("lat"), (F.lit(9) + (F.col("anchor_id") * 104729 % 10000) / 10000 + ((F.col("address_id") * 17 % 200) - 100) / 100000).alias("lon")
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").select(F.col("p_partkey").alias("shape_id"), _at("p_partkey", 7919, 47).alias("lat"), _at("p_partkey", 104729, 9).alias("lon"), (F.col("p_size") * 0.0005).alias("h"))
    at = lambda dy, dx: F.struct((F.col("lat") + F.col("h") * dy).alias("lat"), (F.col("lon") + F.col("h") * dx).alias("lon"))
    square, ell = F.array(at(-1, -1), at(-1, 1), at(1, 1), at(1, -1)), F.array(at(-1, -1), at(-1, 1), at(0, 1), at(0, 0), at(1, 0), at(1, -1))
    return p.select("shape_id", "lat", "lon", "h", (F.col("shape_id") % 4 != 3).alias("closed"), F.when(F.col("shape_id") % 2 == 0, square).otherwise(ell).alias("ring"), (F.col("lat") - F.col("h")).alias("min_lat"), (F.col("lat") + F.col("h")).alias("max_lat"), (F.col("lon") - F.col("h")).alias("min_lon"), (F.col("lon") + F.col("h")).alias("max_lon"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("point_id"), _at("c_custkey", 7919, 47).alias("lat"), _at("c_custkey", 104729, 9).alias("lon"))
