"""Ranks and running sums over all rows without a single task: rows are ordered by range partitions, and only one number of each
partition is carried on to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavuflow.session import materialize


def ranked(rows: DataFrame, order: list[Column], into: str, keep: list[str] | None = None) -> DataFrame:
    """rows (or the columns keep) with into: their place from 0 in the order of all rows; ties are left as they come.

    The sorted rows are written once; the offset of each partition follows from the counts of those before it.
    """
    held = rows.select(*keep) if keep else rows
    part = F.spark_partition_id()
    placed = held.orderBy(*order).withColumns({"_rank_part": part, "_rank_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = materialize(placed, "ranked")
    counts = placed.groupBy("_rank_part").agg(F.count("*").alias("_rank_n"))  # one row for each partition
    before = Window.orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_rank_part", F.coalesce(F.sum("_rank_n").over(before), F.lit(0)).alias("_rank_before"))
    return placed.join(F.broadcast(offsets), "_rank_part").withColumn(into, F.col("_rank_before") + F.col("_rank_at")).drop("_rank_part", "_rank_at", "_rank_before")
