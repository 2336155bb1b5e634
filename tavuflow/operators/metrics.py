"""Evaluation of predicted labels, all as aggregates of (truth, prediction) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavuflow.functions.text import ratio_or_zero

# Rows of a report that are no labels.
NO_LABELS = ("accuracy", "micro avg", "macro avg", "weighted avg")


def confusion(rows: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """by, true_label, pred_label and n."""
    return rows.groupBy(*(by or []), F.col(truth).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("n"))


def report(rows: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """by, label, precision, recall, f1 and support of the labels that occur in the truth; 0 where a ratio is undefined.

    The rows are aggregated once, to the confusion counts; the rest works on those few.
    """
    by = by or []
    cells = confusion(rows, truth, pred, by)
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")),
    )
    flat = cells.select(*by, F.explode(sides).alias("x")).select(*by, "x.*")
    sums = flat.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")]).filter("support > 0")
    precision, recall = ratio_or_zero(F.col("hit"), F.col("predicted")), ratio_or_zero(F.col("hit"), F.col("support"))
    out = sums.withColumns({"precision": precision, "recall": recall})
    f1 = ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).select(*by, "label", "precision", "recall", "f1", "support")


def averages(report_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, and macro and support-weighted means of a report's labels."""
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}")
    return report_.groupBy(*(by or [])).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weighted(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))


def accuracy(rows: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def sentence_accuracy(rows: DataFrame, truth: str, pred: str, sent: str, by: list[str]) -> DataFrame:
    """by and the share of sentences whose every token is right."""
    per = rows.groupBy(*by, sent).agg(F.bool_and(F.col(truth) == F.col(pred)).alias("_right"))
    return per.groupBy(*by).agg(F.avg(F.col("_right").cast("int")).alias("sentence_accuracy"), F.count("*").alias("sentences"))


def merge_folds(fold_reports: DataFrame, by: list[str]) -> DataFrame:
    """by, label and the support-weighted means over the folds."""
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c)
    return fold_reports.groupBy(*by, "label").agg(*[weighted(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))


def mean_of_folds(fold_values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and the unweighted mean of a value over the folds."""
    return fold_values.groupBy(*by).agg(F.avg(value).alias(value))


def sum_of_folds(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, folds, and over the folds: numbers of sentences and epochs summed, whether all runs are right, the mean losses."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("folds"), F.sum("sentences").alias("sentences"), F.sum("epochs").alias("epochs"), F.bool_and("right").alias("right"),
        F.avg("first").alias("first_loss"), F.avg("best").alias("best_loss"),
    )


def log_loss(rows: DataFrame, chance: str, by: list[str], epsilon: float = 1e-15) -> DataFrame:
    """by and the mean of the negative log of the true label's chance."""
    return rows.groupBy(*by).agg(F.avg(-F.log(F.col(chance) + epsilon)).alias("loss"))


def early_stop(losses: DataFrame, by: list[str], epoch: str, loss: str, patience: int = 8, delta: float = 1e-4) -> DataFrame:
    """by, stop_epoch and best: where training stops if the best loss has not improved by more than delta for so many epochs.

    A run has as many rows as epochs; they are folded in order.
    """
    ordered = losses.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(epoch, loss))).alias("e"))
    fold = F.expr(
        f"""aggregate(e, named_struct('best', cast('Infinity' as double), 'bad', 0, 'stop', cast(null as long)), (a, x) ->
              case when a.stop is not null then a
                   when x.{loss} < a.best - {delta} then named_struct('best', cast(x.{loss} as double), 'bad', 0, 'stop', a.stop)
                   else named_struct('best', a.best, 'bad', a.bad + 1, 'stop', if(a.bad + 1 >= {patience}, cast(x.{epoch} as long), null)) end)"""
    )
    return ordered.select(*by, fold.alias("f")).select(*by, F.col("f.stop").alias("stop_epoch"), F.col("f.best").alias("best"))
