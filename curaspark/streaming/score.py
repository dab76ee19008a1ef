"""Scoring as a stream: vectors that arrive are assigned to the centroids of a fit.

Centroids are static, so that scoring is stateless; fitting stays a batch job.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.vectors import assign


def vector_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of vectors as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_stream(vectors: DataFrame, vector: str, centroids: np.ndarray, sink: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the assigned rows to a Parquet table, each input file exactly once."""
    writer = assign(vectors, vector, centroids, drop=(vector,)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def cluster_counts(vectors: DataFrame, vector: str, centroids: np.ndarray, at: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Assigned vectors per cluster and time window, with a watermark for late rows."""
    named = assign(vectors, vector, centroids, drop=(vector,)).withWatermark(at, late)
    return named.groupBy(F.window(at, window), "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg("cosine_to_centroid").alias("mean_cosine"))
