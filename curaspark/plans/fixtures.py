"""The test tables as images, detections and vectors: deterministic, with dyadic coordinates.

orders are images (one in fifty shares its content with the one before), line items are raw detections, the embeddings
are their vectors, and the mean vector of each label is a fitted centroid.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vectors import unit_vectors
from ..operators import detections as D
from ..operators import instances as I
from ..operators import review as R
from ..session import ship_package

PARAMS = D.DetectionParams(threshold=0.35, most=3)
SIGNATURE = "sig"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def images(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    key = F.when(F.col("o_orderkey") % 50 == 1, F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    return o.select(
        F.concat(F.lit("img/"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".png")).alias("image_path"),
        key.alias("content_key"),
        F.sha2(F.concat(F.lit("content:"), key.cast("string")), 256).alias("image_sha256"),
        (320 + 160 * (key % 4)).cast("int").alias("image_width"),
        (240 + 120 * (key % 3)).cast("int").alias("image_height"),
        F.when(F.col("o_orderkey") % 97 == 13, "ERROR").otherwise("OK").alias("image_status"),
    )


def raw_detections(spark: SparkSession, d: str) -> DataFrame:
    """Raw detections with their image's columns; the first line item's box comes twice, with half the score."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    n = table(spark, d, "embeddings").count()
    x = (F.col("l_partkey") * 37) % 2600 / 4.0 - 20.0
    y = (F.col("l_suppkey") * 53) % 1600 / 4.0 - 20.0
    w = (F.col("l_partkey") + 11 * F.col("l_linenumber")) % 320 / 4.0
    h = (F.col("l_suppkey") + 5 * F.col("l_quantity").cast("int")) % 240 / 4.0
    score = F.col("l_quantity") / 50.0
    scores = F.when(F.col("l_linenumber") == 1, F.array(score, score / 2)).otherwise(F.array(score))
    made = li.select(
        F.col("l_orderkey").alias("content_key"), G.box(x, y, x + w, y + h).alias("bbox"), F.explode(scores).alias("score"),
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(0).cast("int").alias("raw_class_id"), ((F.col("l_partkey") + 31 * F.col("l_suppkey") + F.col("l_linenumber")) % n).alias("vec_id"),
    )
    return images(spark, d).join(made, "content_key")


def kept(spark: SparkSession, d: str) -> DataFrame:
    return D.postprocess(raw_detections(spark, d), PARAMS, ("vec_id",))


def instances(spark: SparkSession, d: str) -> DataFrame:
    """Of the images that did not fail."""
    return I.of_objects(I.usable(kept(spark, d)), SIGNATURE)


def centroids(spark: SparkSession, d: str) -> np.ndarray:
    """Mean vector of each label in label order: as many rows as labels."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return np.array([[p.m for p in r.v] for r in means.orderBy("label").collect()])


def assigned_vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, cluster_id, cosine_to_centroid (double)."""
    from ..functions.vectors import assign

    return assign(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", centroids(spark, d), np.float64, ("embedding",))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """Instances with their clusters; the similarity has six decimals, so that ties fall alike in any engine."""
    v = assigned_vectors(spark, d).withColumn("cosine_to_centroid", F.round("cosine_to_centroid", 6))
    return instances(spark, d).join(v, "vec_id")


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(clustered(spark, d))


def unit(spark: SparkSession, d: str) -> DataFrame:
    return unit_vectors(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "embedding")
