"""Injected models over Arrow batches: built once per task on the first row, closed at its end."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import CurationError, RowError
from ..session import map_arrow


def adaptive(items: list, run: Callable[[list], Iterable], retries: int, depth: int = 0) -> list[tuple[Any, Exception | None, int]]:
    """(result, error, halvings) of each item. A failing batch of several items is halved, up to ``retries`` times; errors that end a run pass through."""
    try:
        made = list(run(items))
        if len(made) != len(items):
            raise RuntimeError("a model gave another number of results than of items")
        return [(x, None, depth) for x in made]
    except CurationError as e:
        if not isinstance(e, RowError):
            raise
        error: Exception = e
    except Exception as e:
        error = e
    if len(items) > 1 and depth < retries:
        half = len(items) // 2
        return adaptive(items[:half], run, retries, depth + 1) + adaptive(items[half:], run, retries, depth + 1)
    return [(None, error, depth) for _ in items]


def out_of_memory(error: Exception) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def apply_model(rows: DataFrame, keep: list[str], factory: Callable[[], Any], call: Callable[[Any, list[dict]], Iterable[dict]], out: str, batch_size: int, retries: int, code: str, stage: str) -> DataFrame:
    """``keep`` columns, the model's columns (DDL ``out``) and error_code, error_message, exception_type, retry_count, stage.

    A task without rows builds no model.  ``call`` takes the model and a list of rows and gives a dict per row.
    """
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(out + ", error_code string, error_message string, exception_type string, retry_count int, stage string")
    schema = StructType([*rows.select(*keep).schema.fields, *made.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        model = None
        try:
            for batch in batches:
                table = batch.to_pylist()
                result = []
                for lo in range(0, len(table), batch_size):
                    part = table[lo : lo + batch_size]
                    model = factory() if model is None else model
                    for row, (got, error, depth) in zip(part, adaptive(part, lambda xs: call(model, xs), retries), strict=True):
                        base = {k: row[k] for k in keep} | {"retry_count": depth}
                        if error is None:
                            result.append(base | got)
                        else:
                            name = error.code if isinstance(error, RowError) else f"{code}_OUT_OF_MEMORY" if out_of_memory(error) else f"{code}_FAILED"
                            result.append(base | {"error_code": name, "error_message": str(error), "exception_type": type(error).__name__, "stage": error.stage if isinstance(error, RowError) else stage})
                if result:
                    yield from pa.Table.from_pylist(result, schema=arrow).to_batches()
        finally:
            if model is not None and hasattr(model, "close"):
                model.close()

    return map_arrow(rows, run, schema)
