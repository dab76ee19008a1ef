"""Content-addressed caches as tables partitioned by signature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vectors import valid_unit


def valid_detections(cache: DataFrame, signature: str, threshold: float, most: int) -> DataFrame:
    """Entries that keep the contract; others count as misses."""
    d = F.col("detections")
    w, h = F.col("image_width"), F.col("image_height")

    def ok(x):
        b = x["bbox"]
        inside = (b["xmin"] >= 0) & (b["ymin"] >= 0) & (b["xmax"] <= w) & (b["ymax"] <= h)
        return G.finite_box(b) & inside & (G.width(b) >= 1) & (G.height(b) >= 1) & x["score"].between(threshold, 1.0)

    return cache.filter((F.col("detector_signature") == signature) & (F.size(d) <= most) & F.forall(d, ok)).dropDuplicates(["image_sha256"])


def valid_vectors(cache: DataFrame, signature: str, dimension: int) -> DataFrame:
    return cache.filter((F.col("embedding_signature") == signature) & (F.size("vector") == dimension) & valid_unit(F.col("vector"))).dropDuplicates(["instance_key"])


def hits(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(cache, keys)


def misses(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(cache, keys, "left_anti")


def counters(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """One row: hits and misses, looked up before anything of this run is written."""
    marked = rows.select(*keys).join(cache.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
    return marked.agg(F.count_if(F.col("_there").isNotNull()).alias("hits"), F.count_if(F.col("_there").isNull()).alias("misses"))


def append_new(made: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Write the entries that the cache lacks; equal keys once."""
    spark = made.sparkSession
    fresh = made.dropDuplicates(keys)
    try:
        fresh = fresh.join(spark.read.schema(made.schema).parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").partitionBy(partition).parquet(path)


def read_cache(spark, path: str, schema) -> DataFrame:
    """The cache table, empty where nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
