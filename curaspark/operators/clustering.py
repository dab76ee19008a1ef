"""Spherical k-means: bounded fit, distributed assignment, canonical ids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError, FatalPipelineError
from ..functions.vectors import LEAST_NORM, assign, matrix, normalize
from ..session import map_arrow, spill


@dataclass(frozen=True)
class FitParams:
    k: int
    iterations: int = 25
    restarts: int = 5
    seed: int = 42
    points_per_centroid: int = 256
    empty_retries: int = 3
    backend: str = "local_sample"  # or "mllib_cosine", for samples beyond the driver


@dataclass(frozen=True)
class Fit:
    centroids: np.ndarray
    seed_used: int
    objective: float


def sample_rows(n: int, params: FitParams, seed: int) -> np.ndarray:
    """Ordinals of the training rows: all, or k * points_per_centroid of them."""
    most = params.k * params.points_per_centroid
    return np.arange(n) if n <= most else np.sort(np.random.default_rng(seed).choice(n, most, replace=False))


def training_set(vectors: DataFrame, n: int, params: FitParams, seed: int) -> np.ndarray:
    """Unit rows of the training sample in embedding_row order; its size is bounded by the parameters."""
    chosen = sample_rows(n, params, seed)
    rows = vectors.select("embedding_row", "vector")
    if len(chosen) < n:
        spark = vectors.sparkSession
        ids = spark.createDataFrame([(int(i),) for i in chosen], "embedding_row bigint")
        rows = rows.join(F.broadcast(ids), "embedding_row")
    return normalize(matrix(rows.orderBy("embedding_row").toArrow().column("vector")).astype(np.float32))


def seed_centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ by cosine distance."""
    picked = [int(rng.integers(len(x)))]
    far = np.maximum(0.0, 1.0 - x @ x[picked[0]])
    while len(picked) < k:
        total = float(far.sum())
        picked.append(int(rng.integers(len(x))) if total <= LEAST_NORM else int(rng.choice(len(x), p=far.astype(np.float64) / far.astype(np.float64).sum())))
        far = np.minimum(far, np.maximum(0.0, 1.0 - x @ x[picked[-1]]))
    return x[picked].copy()


def update(x: np.ndarray, which: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """Unit means; an empty cluster takes a worst-placed point (another for each)."""
    sums = np.zeros((k, x.shape[1]), np.float32)
    np.add.at(sums, which, x)
    empty = np.flatnonzero(np.bincount(which, minlength=k) == 0)
    sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.maximum(norm, LEAST_NORM)


def lloyd(x: np.ndarray, params: FitParams, seed: int) -> Fit:
    """Best of the restarts by total similarity; the earliest of equals."""
    best: Fit | None = None
    for restart in range(params.restarts):
        c = seed_centroids(x, params.k, np.random.default_rng(seed + restart))
        for _ in range(params.iterations):
            s = x @ c.T
            which = s.argmax(axis=1)
            new = update(x, which, s[np.arange(len(x)), which], params.k)
            still = np.allclose(new, c, atol=1e-6)
            c = new
            if still:
                break
        objective = float((x @ c.T).max(axis=1).sum())
        if best is None or objective > best.objective:
            best = Fit(c, seed, objective)
    return best


def _mllib(vectors: DataFrame, params: FitParams, seed: int) -> Fit:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # a fixed layout first: the result depends on the partitioning
    rows = vectors.repartitionByRange(8, "embedding_row").sortWithinPartitions("embedding_row").select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    rows.persist()
    models = [KMeans(k=params.k, maxIter=params.iterations, seed=seed + r, distanceMeasure="cosine").fit(rows) for r in range(params.restarts)]
    rows.unpersist()
    model = min(models, key=lambda m: m.summary.trainingCost)
    return Fit(normalize(np.array(model.clusterCenters(), np.float32)), seed, -model.summary.trainingCost)


def cluster_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """Points of each cluster, zero for an empty one."""
    return assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id")).join(assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("cluster_size"))


def fit(vectors: DataFrame, params: FitParams) -> tuple[DataFrame, Fit]:
    """Assigned rows with canonical ids, and the fit with its centroids in that order.

    ``vectors``: embedding_row (0-based ordinal), instance_id, vector.  Fits again with another seed while a cluster of
    the whole table stays empty.
    """
    n = vectors.count()
    if not 2 <= params.k <= n:
        raise ConfigurationError(f"k must be between 2 and the number of vectors ({n}), not {params.k}")
    for retry in range(params.empty_retries + 1):
        seed = params.seed + retry
        got = _mllib(vectors, params, seed) if params.backend == "mllib_cosine" else lloyd(training_set(vectors, n, params, seed), params, seed)
        assigned = spill(assign(vectors, "vector", got.centroids), "assigned")
        if not cluster_sizes(assigned, params.k).filter("cluster_size = 0").limit(1).count():
            named, order = canonical(assigned)
            return named, Fit(got.centroids[order], seed, got.objective)
    raise FatalPipelineError("a cluster stayed empty in every attempt")


def representatives(assigned: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """cluster_id, representative: the least id among the members within the tolerance of the best similarity."""
    # one row per cluster, of which a fit's parameters fix the number: joined back instead of a window over each cluster
    best = assigned.groupBy("cluster_id").agg(F.max("cosine_to_centroid").alias("_best"))
    near = assigned.select("cluster_id", "instance_id", "cosine_to_centroid").join(best, "cluster_id").filter(F.abs(F.col("cosine_to_centroid") - F.col("_best")) <= tolerance)
    return near.groupBy("cluster_id").agg(F.min("instance_id").alias("representative"))


def canonical_ids(assigned: DataFrame) -> DataFrame:
    """old_cluster_id, representative, cluster_id: clusters numbered by their representatives. One row per cluster."""
    ranked = F.row_number().over(Window.orderBy("representative", "cluster_id")) - 1
    return representatives(assigned).select(F.col("cluster_id").alias("old_cluster_id"), "representative", ranked.alias("new")).select("old_cluster_id", "representative", F.col("new").cast("int").alias("cluster_id"))


def canonical(assigned: DataFrame) -> tuple[DataFrame, list[int]]:
    """The rows with canonical cluster ids, and the old ids in the new order (K numbers)."""
    ids = canonical_ids(assigned)
    order = [r.old_cluster_id for r in ids.orderBy("cluster_id").collect()]
    renamed = assigned.withColumnRenamed("cluster_id", "old_cluster_id").join(F.broadcast(ids.select("old_cluster_id", "cluster_id")), "old_cluster_id").drop("old_cluster_id")
    return renamed, order


def lloyd_step(assigned: DataFrame) -> DataFrame:
    """cluster_id, pos, mean of the unit members' numbers, before normalisation: the distributed form of one update."""

    def sums(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("unit"), np.float64)
                ids, which = np.unique(batch.column("cluster_id").to_numpy(), return_inverse=True)
                total = np.zeros((len(ids), x.shape[1]))
                np.add.at(total, which, x)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, x.shape[1]), pa.int32()), pa.array(np.tile(np.arange(x.shape[1], dtype=np.int32), len(ids))), pa.array(total.ravel()), pa.array(np.repeat(np.bincount(which), x.shape[1]))], ["cluster_id", "pos", "s", "n"])

    # vectors are added up a batch at a time: K x D numbers of a batch are shuffled, not one per vector and place
    parts = map_arrow(assigned.select(F.col("cluster_id").cast("int").alias("cluster_id"), "unit"), sums, "cluster_id int, pos int, s double, n bigint")
    return parts.groupBy("cluster_id", "pos").agg((F.sum("s") / F.sum("n")).alias("mean"))
