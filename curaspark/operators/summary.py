"""Counts, checks and summaries of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FatalPipelineError
from ..functions.text import sanitize
from ..schemas import FAILURES, conform
from .ranking import ranked_in_parts


def failure_fraction(images: DataFrame) -> DataFrame:
    return images.agg(F.count(F.lit(1)).alias("n_images"), F.count_if(F.col("image_status") == "ERROR").alias("n_errors"), F.avg((F.col("image_status") == "ERROR").cast("double")).alias("failure_fraction"))


def require_few_failures(images: DataFrame, most: float) -> None:
    """Fatal if the share of failed images is over the ceiling (not at it)."""
    r = failure_fraction(images).first()
    if r.n_images and r.n_errors > most * r.n_images:
        raise FatalPipelineError(f"{r.n_errors} of {r.n_images} images failed; at most {most:.2%} may")


def observed_classes(detections: DataFrame) -> DataFrame:
    """One row: the class ids that occur, in order."""
    return detections.agg(F.sort_array(F.collect_set("raw_class_id")).alias("class_ids"))


def require_one_class(detections: DataFrame) -> list[int]:
    seen = observed_classes(detections).first().class_ids
    if len(seen) > 1:
        raise FatalPipelineError(f"the detector must be class-agnostic, but gave the classes {seen}")
    return seen


def run_counts(images: DataFrame, instances: DataFrame) -> DataFrame:
    """One row of counts; detections of failed images do not count."""
    of = lambda s: F.count_if(F.col("image_status") == s)
    a = images.agg(F.count(F.lit(1)).alias("images"), of("OK").alias("ok_images"), of("NO_DETECTION").alias("no_detection_images"), of("ERROR").alias("error_images"), F.sum(F.when(F.col("image_status") != "ERROR", F.size("detections")).otherwise(0)).alias("detections"))
    b = instances.agg(F.count(F.lit(1)).alias("instances"), F.count_if(F.col("embedding_status").isin("COMPUTED", "CACHED")).alias("embedded_instances"), F.count_if(F.col("embedding_status") == "ERROR").alias("failed_instances"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def statuses_after_embedding(images: DataFrame, instances: DataFrame) -> DataFrame:
    """Images whose instances all failed become errors; those with some failures keep OK and a warning."""
    per = instances.groupBy("image_path").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("embedding_status") == "ERROR").alias("_bad"))
    j = images.join(per, "image_path", "left")
    # as columns first: the expressions would read the statuses that they change
    j = j.withColumn("_lost", F.coalesce((F.col("_n") > 0) & (F.col("_n") == F.col("_bad")) & (F.col("image_status") != "ERROR"), F.lit(False)))
    j = j.withColumn("_some", F.coalesce((F.col("_bad") > 0) & (F.col("_bad") < F.col("_n")), F.lit(False)))
    lost, some = F.col("_lost"), F.col("_some")
    out = j.withColumn("image_status", F.when(lost, "ERROR").otherwise(F.col("image_status")))
    out = out.withColumn("error_code", F.when(lost, F.lit("ALL_INSTANCE_EMBEDDINGS_FAILED")).when(some, F.lit(None)).otherwise(F.col("error_code")))
    out = out.withColumn("error_message", F.when(lost, F.lit("no instance of the image could be embedded")).when(some, F.lit(None)).otherwise(F.col("error_message")))
    warned = F.array_union("warning_codes", F.array(F.lit("PARTIAL_INSTANCE_EMBEDDING_FAILURES")))
    return out.withColumn("warning_codes", F.when(some, warned).otherwise(F.col("warning_codes"))).drop("_n", "_bad", "_lost", "_some")


def cluster_summary(instances: DataFrame) -> DataFrame:
    """Size, similarities and representative (most similar, then least id) of each cluster, in order of the clusters."""
    key = F.struct((-F.col("cosine_to_centroid")).alias("_s"), F.col("instance_id").alias("_i"))
    c = F.col("cosine_to_centroid")
    return instances.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"), F.min_by("instance_id", key).alias("representative_instance_id"), F.avg(c).alias("mean_cosine_to_centroid"), F.min(c).alias("min_cosine_to_centroid"), F.max(c).alias("max_cosine_to_centroid")
    ).orderBy("cluster_id")


def embedding_rows(instances: DataFrame, order: list[str], name: str = "embedding_row", partitions: int | None = None) -> DataFrame:
    """0-based ordinals in a global order without a single-partition window."""
    return ranked_in_parts(instances, [F.col(c) for c in order], name, partitions=partitions).withColumn(name, F.col(name) - 1)


def failure_log(parts: list[DataFrame]) -> DataFrame:
    """All stages' failures with sanitised messages, in the declared schema."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return conform(out.withColumn("sanitized_message", sanitize(F.col("message"))).drop("message"), FAILURES)


def input_manifest_sha(rows: DataFrame) -> str:
    """SHA-256 of the canonical JSON of all image rows in path order, fed row by row."""
    import hashlib

    from ..functions.hashing import canonical_json

    out = hashlib.sha256(b"[")
    for k, r in enumerate(rows.orderBy("image_path").toLocalIterator()):
        out.update((("," if k else "") + canonical_json(r.asDict(recursive=True))).encode())
    out.update(b"]")
    return out.hexdigest()
