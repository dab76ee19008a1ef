"""Ranks in a total order without a window over a whole group or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spill


def ranked_in_parts(rows: DataFrame, order: list[Column], rank: str, size: str | None = None, group: str | None = None, partitions: int | None = None) -> DataFrame:
    """Adds the 1-based rank in ``order`` (a total one), in each group or over all, and the group's size.

    Rows are range-partitioned by (group, order), so that a group of any size is spread; they are numbered inside their
    partition and shifted by the counts of the partitions before, which are a row per group and partition.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [group] if group else []
    cut = rows.repartitionByRange(n, *map(F.col, by), *order).withColumn("_part", F.spark_partition_id())
    # written, so that both readers see the same partitions
    inside = spill(cut.withColumn("_inside", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))), "ranked")
    per = inside.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("_part").alias("_q"), *(F.col(g).alias("_g") for g in by), before.alias("_before"), F.sum("_n").over(whole).alias("_size"))
    same = F.col("_part") == F.col("_q")
    if group:
        same &= F.col(group).eqNullSafe(F.col("_g"))
    out = inside.join(per, same).withColumn(rank, (F.col("_before") + F.col("_inside")).cast("int" if group else "long"))
    return (out.withColumn(size, F.col("_size")) if size else out).drop("_part", "_inside", "_q", "_g", "_before", "_size")
