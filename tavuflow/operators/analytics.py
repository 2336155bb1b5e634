"""Comparison of results over runs and strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavuflow.operators.metrics import NO_LABELS

METRICS = ("precision", "recall", "f1")


def labels_only(reports: DataFrame) -> DataFrame:
    """Report rows of labels, each delivered row once."""
    return reports.filter(~F.col("label").isin(*NO_LABELS)).distinct()


def run_delta(reports: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run, label and the metrics' changes against the run before.

    Each label of the old run comes out; what the new run lacks counts as 0; labels only in the new run do not. Only keys
    that both runs have are compared.
    """
    rows = labels_only(reports)
    old = rows.select(*keys, (F.col("run") + 1).alias("run"), "label", *[F.coalesce(c, F.lit(0.0)).alias(f"old_{c}") for c in METRICS])
    new = rows.select(*keys, "run", "label", *METRICS)
    both = both_runs(reports, keys)
    joined = old.join(both, [*keys, "run"], "left_semi").join(new, [*keys, "run", "label"], "left")
    return joined.select(*keys, "run", "label", *[(F.coalesce(c, F.lit(0.0)) - F.col(f"old_{c}")).alias(f"{c}_change") for c in METRICS])


def both_runs(reports: DataFrame, keys: list[str]) -> DataFrame:
    """keys and run: what is there in the run and in the run before."""
    have = reports.select(*keys, "run").distinct()
    before = have.select(*keys, (F.col("run") + 1).alias("run"))
    return have.join(before, [*keys, "run"], "left_semi")


def mean_change(deltas: DataFrame, by: list[str]) -> DataFrame:
    return deltas.groupBy(*by).agg(F.avg("f1_change").alias("f1_change"))


def pivot_change(deltas: DataFrame, row: list[str], column: str, values: list[str]) -> DataFrame:
    """row and one column for each value: the mean change. The values are named, so one pass suffices."""
    return deltas.groupBy(*row).pivot(column, values).agg(F.avg("f1_change"))


def top(rows: DataFrame, by: list[str], value: str, name: str, n: int = 5, largest: bool = True) -> DataFrame:
    """The n rows of each group with the largest (smallest) value, with their rank; ties by name."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, F.col(name)))).filter(F.col("rank") <= n)


def ranking(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with their place by value, ties by name backwards; a missing value counts as 0."""
    filled = rows.withColumn(value, F.coalesce(value, F.lit(0.0)))
    return filled.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(name).desc())))


def macro_f1(reports: DataFrame, by: list[str]) -> DataFrame:
    """by and the unweighted mean F1 of the labels, 0 without any."""
    return labels_only(reports).groupBy(*by).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def histogram(tokens: DataFrame, tag: str, order: str, by: list[str] | None = None) -> DataFrame:
    """by, tag, n and place: tags by count, ties in the order of their first row."""
    by = by or []
    counts = tokens.filter(F.col(tag).isNotNull()).groupBy(*by, tag).agg(F.count("*").alias("n"), F.min(order).alias("first_at"))
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return counts.withColumn("place", F.row_number().over(spec.orderBy(F.desc("n"), "first_at")))
