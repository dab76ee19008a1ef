"""Instances and their identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import hashing as H
from ..functions.vectors import box_key


def occurrence(key: str = "bbox_key", order: Column | None = None) -> Column:
    """How many equal boxes of the image come before, in detection order."""
    return F.row_number().over(Window.partitionBy("image_path", key).orderBy(F.col("det_rank") if order is None else order)) - 1


def usable(images: DataFrame) -> DataFrame:
    """Images that instances are built from."""
    return images.filter((F.col("image_status") != "ERROR") & F.col("image_sha256").isNotNull())


def of_objects(detections: DataFrame, detector_signature: str) -> DataFrame:
    """One instance per kept detection: image_path, image_sha256, bbox, score, det_rank and others."""
    b = F.col("bbox")
    keyed = detections.withColumn("bbox_key", box_key(b["xmin"], b["ymin"], b["xmax"], b["ymax"])).withColumn("occurrence", occurrence())
    keyed = keyed.withColumn("instance_key", H.instance_key(F.col("image_sha256"), F.col("bbox_key"), F.lit(detector_signature), F.col("occurrence")))
    return keyed.withColumn("instance_id", H.instance_id(F.col("image_path"), F.col("instance_key"))).withColumn("bbox_xywh", G.integer_xywh(b)).withColumn("embedding_granularity", F.lit("object"))


def of_images(images: DataFrame) -> DataFrame:
    """One instance per image, its box the whole image and its score the best detection's (0 without one)."""
    made = images.withColumn("instance_key", H.image_key(F.col("image_sha256"))).withColumn("bbox", G.box(F.lit(0.0), F.lit(0.0), F.col("image_width"), F.col("image_height")))
    made = made.withColumn("instance_id", H.instance_id(F.col("image_path"), F.col("instance_key"))).withColumn("score", F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)))
    return made.withColumn("bbox_xywh", G.integer_xywh(F.col("bbox"))).withColumn("det_rank", F.lit(1)).withColumn("occurrence", F.lit(0)).withColumn("raw_class_id", F.lit(None).cast("int")).withColumn("embedding_granularity", F.lit("image"))


def duplicate_content(instances: DataFrame) -> DataFrame:
    """Keys that several instances share, with their counts: they cost one embedding."""
    return instances.groupBy("instance_key").agg(F.count(F.lit(1)).alias("n_instances"), F.countDistinct("image_path").alias("n_images")).filter("n_instances > 1")
