"""Vector kernels over Arrow batches: a list column becomes one matrix, without a Python object per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import FatalPipelineError
from ..session import map_arrow

LEAST_NORM = 1e-12


def matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    """Rows of a list column as a matrix; rows of differing or null length are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0), dtype)
    if column.null_count or pc.min(pc.list_value_length(column)) != pc.max(pc.list_value_length(column)):
        raise FatalPipelineError("vectors must be present and of one length")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype).reshape(n, -1)


def normalize(rows: np.ndarray) -> np.ndarray:
    """Unit rows; an empty matrix, a value that is not finite or a zero row is an error."""
    if rows.ndim != 2 or not rows.size:
        raise ValueError("vectors must form a matrix with rows")
    if not np.isfinite(rows).all():
        raise ValueError("vectors must be finite")
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    if (norm <= LEAST_NORM).any():
        raise ValueError("a vector has no direction")
    return rows / norm


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the most similar unit centroid (the first of equals) and the similarity in [-1, 1]."""
    scores = normalize(rows) @ centroids.T
    best = scores.argmax(axis=1)
    return best, np.clip(scores[np.arange(len(best)), best], -1.0, 1.0)


def map_batches(df: DataFrame, added: str, kernel: Callable[[pa.RecordBatch], list], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop`` and with the columns ``added`` (DDL) that the kernel makes of each batch; one narrow stage."""
    keep = [c for c in df.columns if c not in drop]
    schema = StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(added).fields])
    types = [f.dataType.simpleString() for f in StructType.fromDDL(added)]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [x if isinstance(x, pa.Array) else pa.array(x, arrow[t]) for x, t in zip(kernel(batch), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], schema.names)

    return map_arrow(df, run, schema)


def list_column(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(rows.ravel()))


def assign(df: DataFrame, vector: str, centroids: np.ndarray, dtype=np.float32, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds cluster_id and cosine_to_centroid by a matrix product per batch.

    The centroids are K x D numbers that the caller holds already (bounded by the fit), sent once per executor.
    """
    unit = normalize(np.asarray(centroids, dtype)).astype(dtype)
    held = df.sparkSession.sparkContext.broadcast(unit)

    def kernel(batch: pa.RecordBatch) -> list:
        rows = matrix(batch.column(vector), dtype)
        if rows.shape[1] != held.value.shape[1]:
            raise FatalPipelineError(f"vectors have {rows.shape[1]} dimensions, centroids {held.value.shape[1]}")
        best, similarity = nearest(rows, held.value)
        return [best.astype(np.int32), similarity]

    return map_batches(df, f"cluster_id int, cosine_to_centroid {'float' if dtype == np.float32 else 'double'}", kernel, drop)


def unit_vectors(df: DataFrame, vector: str, out: str = "unit", half: bool = False) -> DataFrame:
    """Adds the unit vector; ``half``: rounded to 16-bit floats and back, as vectors are stored."""

    def kernel(batch: pa.RecordBatch) -> list:
        rows = normalize(matrix(batch.column(vector), np.float64 if not half else np.float32))
        return [list_column(rows.astype(np.float16).astype(np.float32) if half else rows)]

    return map_batches(df, f"{out} array<{'float' if half else 'double'}>", kernel)


def valid_unit(v: Column, low: float = 0.98, high: float = 1.02) -> Column:
    """Whether a stored vector is finite and nearly of unit length."""
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.isNotNull() & finite & norm.between(low, high)


def box_key(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Four decimals of each side, rounded from the exact binary value (JVM formatting rounds the shortest decimal instead)."""

    def key(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([f"{w:.4f},{x:.4f},{y:.4f},{z:.4f}" for w, x, y, z in zip(a, b, c, d, strict=True)], dtype=object)

    return F.pandas_udf(key, "string")(xmin, ymin, xmax, ymax)


def display_round(x: Column) -> Column:
    """Eight decimals by the same rule."""

    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v != v else round(float(v), 8))

    return F.pandas_udf(cut, "double")(x)
