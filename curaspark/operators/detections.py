"""Raw detections to kept detections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


@dataclass(frozen=True)
class DetectionParams:
    threshold: float = 0.35
    most: int = 20  # detections of an image
    least_side: float = 1.0


def order_keys(b: Column = None, *extra: Column) -> list[Column]:
    b = F.col("bbox") if b is None else b
    return [F.col("score").desc(), *(b[k].asc() for k in G.SIDES), F.coalesce(F.col("raw_class_id"), F.lit(-1)).asc(), *extra]


def postprocess(raw: DataFrame, params: DetectionParams = DetectionParams(), tie: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """Threshold, clip, drop thin boxes, clamp the score, rank in each image and cap; adds det_rank from 1.

    ``raw``: image_path, image_width, image_height, bbox, score, raw_class_id and others.  The threshold looks at the
    raw score; the cap counts what the other steps leave.  The rank limit is pushed below the shuffle by Catalyst.
    """
    taken = raw.filter((F.col("score") >= params.threshold) & G.finite(F.col("score")) & G.finite_box(F.col("bbox")))
    clipped = taken.withColumn("bbox", G.clip(F.col("bbox"), F.col("image_width"), F.col("image_height")))
    clipped = clipped.filter((G.width(F.col("bbox")) >= params.least_side) & (G.height(F.col("bbox")) >= params.least_side))
    clipped = clipped.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    rank = F.row_number().over(Window.partitionBy("image_path").orderBy(*order_keys(None, *(F.col(c) for c in tie))))
    return clipped.withColumn("det_rank", rank).filter(F.col("det_rank") <= params.most)


def nest(kept: DataFrame) -> DataFrame:
    """One row per image: detections in rank order."""
    one = F.struct("det_rank", "bbox", "score", "raw_class_id")
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda d: F.struct(d["bbox"].alias("bbox"), d["score"].alias("score"), d["raw_class_id"].alias("raw_class_id")))
    return kept.groupBy("image_path").agg(ordered.alias("detections"))


def with_status(images: DataFrame, nested: DataFrame) -> DataFrame:
    """Images with their detections; OK without any becomes NO_DETECTION."""
    joined = images.join(nested, "image_path", "left")
    none = F.lit(None).cast(dict(nested.dtypes)["detections"])
    empty = F.coalesce("detections", F.filter(F.array(none[0]), lambda _: F.lit(False)))
    return joined.withColumn("detections", empty).withColumn("image_status", F.when((F.col("image_status") == "OK") & (F.size("detections") == 0), "NO_DETECTION").otherwise(F.col("image_status")))
