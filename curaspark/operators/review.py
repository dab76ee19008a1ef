"""Ranks inside clusters, the order of review, and the review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vectors import display_round
from ..schemas import REVIEW, conform
from .ranking import ranked_in_parts

#: Category of a detection, and the order of rows without a cluster.
CATEGORY = "defect"


def _similar_first() -> list[Column]:
    return [F.col("cosine_to_centroid").desc_nulls_last(), F.col("score").desc(), F.col("instance_id").asc()]


def ranked(instances: DataFrame) -> DataFrame:
    """Adds cluster_rank (from 1) and cluster_size; both null without a cluster. A cluster of any size is spread over tasks."""
    there = F.col("cluster_id").isNotNull()
    out = ranked_in_parts(instances, _similar_first(), "cluster_rank", "cluster_size", "cluster_id")
    return out.withColumn("cluster_rank", F.when(there, F.col("cluster_rank"))).withColumn("cluster_size", F.when(there, F.col("cluster_size")))


def primary(instances: DataFrame) -> DataFrame:
    """The clustered instance of each image with the best score, then the least id. A grouped minimum: no sort."""
    key = F.struct((-F.col("score")).alias("_s"), F.col("instance_id").alias("_i"))
    row = F.struct("instance_id", "cluster_id", "cosine_to_centroid", "score")
    return instances.filter(F.col("cluster_id").isNotNull()).groupBy("image_path").agg(F.min_by(row, key).alias("p")).select("image_path", "p.*")


def review_order(instances: DataFrame) -> DataFrame:
    """image_path, cluster_id, review_order: images ranked in their primary instance's cluster."""
    return ranked_in_parts(primary(instances), _similar_first(), "review_order", group="cluster_id").select("image_path", "cluster_id", "review_order")


def _xywh(x: Column) -> Column:
    return F.array(x["x"], x["y"], x["w"], x["h"])


def _json(x: Column) -> Column:
    return F.to_json(x, {"ignoreNullFields": "false"})


def review_rows(images: DataFrame, instances: DataFrame, run_id: str, granularity: str = "object", exact_text: bool = False) -> DataFrame:
    """One row per image in the declared schema, not yet sorted.

    ``images``: image_path, image_status, image_width, image_height, detections, error_code, error_message;
    ``instances``: ranked ones with bbox_xywh, score, embedding_status, warning_codes.  ``exact_text`` rounds the
    numbers shown as Python does, by an Arrow function.
    """
    show = display_round if exact_text else (lambda c: F.round(c, 8))
    shown = instances.withColumn("_score", show(F.col("score"))).withColumn("_cos", show(F.col("cosine_to_centroid").cast("double")))
    whole = granularity == "image"
    # JSON keys in alphabetical order, as the text is canonical
    common = dict(
        bbox_xywh=_xywh(F.col("bbox_xywh")), cluster_id=F.col("cluster_id"), cluster_rank=F.col("cluster_rank"), cluster_size=F.col("cluster_size"), cosine_to_centroid=F.col("_cos"), embedding_granularity=F.lit(granularity),
        embedding_status=F.col("embedding_status"), instance_id=F.col("instance_id"), warning_codes=F.col("warning_codes"), **({"max_detector_score": F.col("_score"), "num_detections": F.col("_n")} if whole else {"detector_score": F.col("_score")}),
    )
    if whole:
        shown = shown.join(images.select("image_path", F.size("detections").alias("_n")), "image_path")
    one = F.struct((-F.col("score")).alias("_s"), F.col("instance_id").alias("_i"), F.col("cluster_id").alias("_c"), _xywh(F.col("bbox_xywh")).alias("_b"), F.struct(*(common[k].alias(k) for k in sorted(common))).alias("_x"))
    by_image = shown.groupBy("image_path").agg(F.array_sort(F.collect_list(one)).alias("_in"))
    joined = images.join(by_image, "image_path", "left").join(review_order(instances).select("image_path", "review_order"), "image_path", "left")
    error = F.col("image_status") == "ERROR"
    dets = F.filter("detections", lambda _: ~error)
    ins = F.filter(F.coalesce("_in", F.array()), lambda _: ~error)
    clustered = F.filter(ins, lambda i: i["_c"].isNotNull())
    lead = F.get(clustered, F.lit(0))["_c"]
    boxed = lambda d, category: F.struct(_xywh(G.integer_xywh(d["bbox"])).alias("bbox"), category.alias("category"))
    if whole:
        per_cluster = F.when(lead.isNotNull(), F.transform(dets, lambda d: boxed(d, lead.cast("string")))).otherwise(F.filter(F.transform(dets, lambda d: boxed(d, lead.cast("string"))), lambda _: F.lit(False)))
    else:
        per_cluster = F.transform(clustered, lambda i: F.struct(i["_b"].alias("bbox"), i["_c"].cast("string").alias("category")))
    scores = F.transform(dets, lambda d: F.round(d["score"], 8))
    out = joined.select(
        "image_path", "image_status", "image_width", "image_height", F.size(dets).alias("num_defects"), lead.alias("primary_cluster_id"), "review_order",
        _json(F.transform(dets, lambda d: boxed(d, F.lit(CATEGORY)))).alias("detection_bbox"), _json(scores).alias("detection_score"), _json(per_cluster).alias("detection_bbox_cluster"),
        _json(F.transform(ins, lambda i: i["_x"])).alias("instances_json"), "error_code", "error_message", F.lit(run_id).alias("run_id"),
    )
    return conform(out, REVIEW)


def in_review_order(rows: DataFrame) -> DataFrame:
    """Clustered rows by cluster and order, then those without a detection, then the rest."""
    bucket = F.when(F.col("primary_cluster_id").isNotNull(), 0).when(F.col("image_status") == "NO_DETECTION", 1).otherwise(2)
    return rows.orderBy(bucket, F.coalesce("primary_cluster_id", F.lit(0)), F.coalesce("review_order", F.lit(0)), "image_path")
