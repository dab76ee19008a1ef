"""One query per operator, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.audit import bound_column
from ..functions.hashing import image_key, instance_id
from ..operators import caching, clustering, detections, summary
from ..operators import instances as inst
from ..operators import review as R
from . import fixtures as X

CROP, PADDING, GRID = 512, 0.15, 8


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths made of urls, some of them unsafe, hidden or of another kind."""
    k = F.col("page_id") % 10
    tail = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "")
    raw = F.when(k == 0, F.concat(tail, F.lit("/.hidden/a.png"))).when(k == 1, F.concat(tail, F.lit("/__MACOSX/a.png"))).when(k == 2, F.concat(tail, F.lit("/Thumbs.db"))).when(k == 3, F.concat(tail, F.lit("/../a.png")))
    raw = raw.when(k == 4, F.concat(F.lit("x\\"), F.col("page_id").cast("string"), F.lit("\\B.JPEG"))).when(k == 5, F.concat(tail, F.lit("//b.Jpg"))).when(k == 6, F.concat(tail, F.lit("/_u.png"))).otherwise(F.concat(tail, F.lit("/c.gif")))
    return X.table(spark, d, "pages").select("page_id", raw.alias("raw_path"))


def eligible_paths(spark, d):
    named = _paths(spark, d).select("page_id", T.normalize_path(F.col("raw_path")).alias("image_path"))
    return named.filter(F.col("image_path").isNotNull() & T.eligible(F.col("image_path")))


def _flat(df: DataFrame, *cols) -> DataFrame:
    return df.select("image_path", "vec_id", *cols)


def _sides(b) -> list:
    return [b[k].alias(k) for k in G.SIDES]


def detections_postprocess(spark, d):
    return _flat(X.kept(spark, d), "det_rank", "score", "raw_class_id", *_sides(F.col("bbox")))


def bbox_xywh(spark, d):
    raw = X.raw_detections(spark, d)
    w, h = F.col("image_width"), F.col("image_height")
    clipped = G.clip(F.col("bbox"), w, h)
    grown = G.expand(clipped, 0.25, w, h)
    x = G.integer_xywh(clipped)
    return _flat(raw, "score", *(x[k].alias(k) for k in "xywh"), G.area(clipped).alias("area"), G.degenerate(clipped).alias("degenerate"), *(grown[k].alias(f"grown_{k}") for k in G.SIDES))


def letterbox_geometry(spark, d):
    k = X.kept(spark, d)
    w, h = F.col("image_width"), F.col("image_height")
    k = k.withColumn("crop", G.crop_box(G.expand(F.col("bbox"), 0.25, w, h), w, h)).withColumn("lb", G.letterbox(F.col("crop"), CROP))
    m = G.into_letterbox(F.col("bbox"), F.col("crop"), F.col("lb"), CROP)
    cut = lambda c: F.round(c, 6)
    return _flat(k, "det_rank", *(F.col("crop")[s].alias(f"crop_{s}") for s in G.SIDES), "lb.resized_width", "lb.resized_height", "lb.pad_left", "lb.pad_top", *(cut(m[s]).alias(f"map_{s}") for s in G.SIDES))


def instance_identity(spark, d):
    return _flat(X.instances(spark, d), "det_rank", "occurrence", "bbox_key", "instance_key", "instance_id")


def image_identity(spark, d):
    key = image_key(F.col("image_sha256"))
    return inst.usable(X.images(spark, d)).select("image_path", key.alias("instance_key"), instance_id(F.col("image_path"), key).alias("instance_id"))


def duplicate_content(spark, d):
    return inst.duplicate_content(X.instances(spark, d))


def _cached(i: DataFrame) -> DataFrame:
    return i.filter(F.substring("instance_key", 1, 1) < "8").select("instance_key").distinct()


def cache_hits(spark, d):
    i = X.instances(spark, d).select("instance_id", "instance_key")
    return caching.hits(i, _cached(i), ["instance_key"])


def cache_misses(spark, d):
    i = X.instances(spark, d).select("instance_id", "instance_key")
    return caching.misses(i, _cached(i), ["instance_key"])


def cache_counters(spark, d):
    i = X.instances(spark, d).select("instance_id", "instance_key")
    return caching.counters(i, _cached(i), ["instance_key"])


def l2_normalize(spark, d):
    return X.unit(spark, d).select("vec_id", F.posexplode("unit").alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def centroid_assign(spark, d):
    return X.assigned_vectors(spark, d).select("vec_id", "cluster_id", F.round("cosine_to_centroid", 6).alias("cosine_to_centroid"))


def canonical_cluster_ids(spark, d):
    a = X.clustered(spark, d).select("instance_id", "cluster_id", "cosine_to_centroid")
    return clustering.canonical_ids(a)


def cluster_rank(spark, d):
    return X.ranked(spark, d).select("instance_id", "cluster_id", "cosine_to_centroid", "cluster_rank", "cluster_size")


def review_order(spark, d):
    return R.review_order(X.clustered(spark, d))


def _review_images(spark, d) -> DataFrame:
    nested = detections.nest(X.kept(spark, d))
    i = detections.with_status(X.images(spark, d), nested)
    return i.withColumn("error_code", F.when(F.col("image_status") == "ERROR", "IMAGE_DECODE_FAILED")).withColumn("error_message", F.lit(None).cast("string"))


def review_rows(spark, d):
    i = X.ranked(spark, d).withColumn("embedding_status", F.lit("COMPUTED")).withColumn("warning_codes", F.array().cast("array<string>"))
    out = R.review_rows(_review_images(spark, d), i, "run")
    # the JSON columns as what they say: numbers print differently in other engines
    box = "array<struct<bbox:array<int>,category:string>>"
    parsed = lambda c, s: F.from_json(F.col(c), s)
    text = lambda b: F.array_join(F.transform(b, lambda x: F.concat_ws(":", F.array_join(x["bbox"], ","), x["category"])), ";")
    ids = F.array_join(F.transform(parsed("instances_json", "array<struct<instance_id:string,cluster_rank:int>>"), lambda x: F.concat_ws(":", x["instance_id"], x["cluster_rank"].cast("string"))), ";")
    return out.select(
        "image_path", "image_status", "image_width", "image_height", "num_defects", "primary_cluster_id", "review_order", text(parsed("detection_bbox", box)).alias("boxes"), text(parsed("detection_bbox_cluster", box)).alias("cluster_boxes"),
        ids.alias("instances"), F.aggregate(parsed("detection_score", "array<double>"), F.lit(0.0), lambda a, x: a + x).alias("_s"), "error_code", "run_id",
    ).withColumn("score_sum", F.round("_s", 4)).drop("_s")


def status_derivation(spark, d):
    return _review_images(spark, d).select("image_path", "image_status", F.size("detections").alias("n_detections"))


def cluster_summary(spark, d):
    s = summary.cluster_summary(X.clustered(spark, d))
    return s.select("cluster_id", "cluster_size", "representative_instance_id", *(F.round(c, 6).alias(c) for c in ("mean_cosine_to_centroid", "min_cosine_to_centroid", "max_cosine_to_centroid")))


def _with_failures(spark, d) -> DataFrame:
    """Instances of which some, by their key, could not be embedded."""
    bad = F.substring("instance_key", 1, 1).isin("0", "1", "2")
    return X.instances(spark, d).withColumn("embedding_status", F.when(bad, "ERROR").when(F.substring("instance_key", 1, 1) < "8", "CACHED").otherwise("COMPUTED"))


def embedding_statuses(spark, d):
    i = _review_images(spark, d).withColumn("warning_codes", F.array().cast("array<string>"))
    out = summary.statuses_after_embedding(i, _with_failures(spark, d).select("image_path", "embedding_status"))
    return out.select("image_path", "image_status", "error_code", F.array_join("warning_codes", ",").alias("warnings"))


def run_counts(spark, d):
    return summary.run_counts(_review_images(spark, d), _with_failures(spark, d))


def failure_fraction(spark, d):
    return summary.failure_fraction(X.images(spark, d)).withColumn("failure_fraction", F.round("failure_fraction", 6))


def observed_classes(spark, d):
    return summary.observed_classes(X.raw_detections(spark, d)).select(F.array_join(F.transform("class_ids", lambda x: x.cast("string")), ",").alias("class_ids"))


def failures_log(spark, d):
    e = X.table(spark, d, "events")
    k = F.col("event_id") % 3
    said = F.concat(F.lit("cannot  open /data/in put/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".png:\n\t"), F.repeat(F.coalesce("props", F.lit("")), F.when(k == 1, 40).otherwise(1)))
    base = e.select(
        F.lit("run").alias("run_id"), F.concat(F.lit("img/"), F.col("event_id").cast("string")).alias("image_path"), F.lit(None).cast("string").alias("image_sha256"), F.lit(None).cast("string").alias("instance_id"), k.alias("_k"),
        F.lit("ValueError").alias("exception_type"), said.alias("message"), F.lit(0).alias("retry_count"), F.lit("2024-01-01T00:00:00Z").alias("occurred_at_utc"),
    )
    part = lambda n, stage, code: base.filter(F.col("_k") == n).drop("_k").withColumn("stage", F.lit(stage)).withColumn("error_code", F.lit(code))
    log = summary.failure_log([part(0, "read", "IMAGE_READ_FAILED"), part(1, "decode", "IMAGE_DECODE_FAILED"), part(2, "detection", "DETECTOR_FAILED")])
    return log.select("image_path", "stage", "error_code", "sanitized_message", "retry_count")


def source_changed(spark, d):
    from ..sources.images import changed

    first = X.images(spark, d).select("image_path", "image_sha256")
    n = F.substring("image_path", 5, 8).cast("bigint")
    second = first.filter(n % 41 != 7).withColumn("image_sha256", F.when(n % 29 == 3, F.sha2(F.concat("image_sha256", F.lit("x")), 256)).otherwise(F.col("image_sha256")))
    return changed(first, second)


def embedding_row(spark, d):
    return summary.embedding_rows(X.instances(spark, d).select("image_path", "det_rank", "instance_id"), ["image_path", "det_rank"])


def cluster_sizes(spark, d):
    return clustering.cluster_sizes(X.assigned_vectors(spark, d), 12)


def lloyd_step(spark, d):
    a = X.unit(spark, d).join(X.assigned_vectors(spark, d), "vec_id")
    return clustering.lloyd_step(a).select("cluster_id", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"))


def lloyd_objective(spark, d):
    return X.assigned_vectors(spark, d).agg(F.round(F.sum("cosine_to_centroid"), 4).alias("objective"))


def spherical_kmeans_fit(spark, d):
    v = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("embedding_row"), F.format_string("v%06d", "vec_id").alias("instance_id"), F.col("embedding").alias("vector"))
    named, _ = clustering.fit(v, clustering.FitParams(k=10))
    return named.select("instance_id", "cluster_id", "cosine_to_centroid")


def fractional_weights(spark, d):
    b = F.col("bbox")
    square = G.box(b["xmin"] % 256, b["ymin"] % 256, b["xmin"] % 256 + G.width(b), b["ymin"] % 256 + G.height(b))
    k = _flat(X.kept(spark, d).filter("det_rank = 1"), G.patch_weights(square, GRID, GRID, 512.0, 512.0).alias("w"))
    return k.select("image_path", "vec_id", F.posexplode("w").alias("patch", "weight")).filter("weight > 0").select("image_path", "vec_id", F.col("patch").cast("bigint").alias("patch"), "weight")


def pooled_vector(spark, d):
    """The vector as a 4 x 4 map of 4 channels, pooled under a box that depends on its id."""
    import numpy as np

    from ..functions import pooling
    from ..functions.vectors import list_column, map_batches, matrix

    def kernel(batch):
        maps = matrix(batch.column("embedding"), np.float64).reshape(-1, 4, 4, 4)
        out = []
        for i, f in zip(batch.column("vec_id").to_pylist(), maps, strict=True):
            x, y = (i % 5) * 8.0, (i % 3) * 8.0
            out.append(pooling.pool(f, (x, y, x + 24.0, y + 20.0), 64.0, 0.5).vector)
        return [list_column(np.array(out, np.float64))]

    made = map_batches(X.table(spark, d, "embeddings").select("vec_id", "embedding"), "v array<double>", kernel, ("embedding",))
    return made.select("vec_id", F.posexplode("v").alias("channel", "x")).select("vec_id", F.col("channel").cast("bigint").alias("channel"), F.round("x", 4).alias("x"))


def audit_counts(spark, d):
    j = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_correct"))


def audit_bound(spark, d):
    a = audit_counts(spark, d)
    return a.withColumn("lower_bound", F.round(bound_column(F.col("n_correct"), F.col("n")), 6))


def bundle_validate(spark, d):
    from .bundle import demo_errors

    return demo_errors(spark)


ALL = (
    eligible_paths, detections_postprocess, bbox_xywh, letterbox_geometry, instance_identity, image_identity, duplicate_content, cache_hits, cache_misses, cache_counters, l2_normalize, centroid_assign, canonical_cluster_ids,
    cluster_rank, review_order, review_rows, status_derivation, cluster_summary, embedding_statuses, run_counts, failure_fraction, observed_classes, failures_log, source_changed, embedding_row, cluster_sizes, lloyd_step,
    lloyd_objective, spherical_kmeans_fit, fractional_weights, pooled_vector, audit_counts, audit_bound, bundle_validate,
)
QUERIES = {f.__name__: f for f in ALL}
