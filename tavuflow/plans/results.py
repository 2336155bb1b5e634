"""Results over runs and strategies: deltas, pivots, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.config import STRATEGIES
from tavuflow.operators import analytics as A
from tavuflow.session import table

_KEYS = ["lang", "strategy"]


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports").filter("label is not null and run is not null").select("lang", "strategy", "run", "label", "precision", "recall", "f1", "support")


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`").cast("long" if t == "int" and c in ("place", "rank") else t).alias(c) for c, t in df.dtypes])


def _delta(spark: SparkSession, d: str) -> DataFrame:
    return A.run_delta(_reports(spark, d), _KEYS)


def run_delta(spark: SparkSession, d: str) -> DataFrame:
    return _r(_delta(spark, d))


def runs_in_both(spark: SparkSession, d: str) -> DataFrame:
    return A.both_runs(_reports(spark, d), _KEYS)


def delta_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.mean_change(_delta(spark, d), ["lang", "run", "strategy"]))


def delta_by_entity_top5(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.top(A.mean_change(_delta(spark, d), ["lang", "run", "label"]).withColumn("f1_change", F.round("f1_change", 9)), ["lang", "run"], "f1_change", "label"))


def delta_by_entity_bottom5(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.top(A.mean_change(_delta(spark, d), ["lang", "run", "label"]).withColumn("f1_change", F.round("f1_change", 9)), ["lang", "run"], "f1_change", "label", largest=False))


def delta_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.pivot_change(_delta(spark, d), ["lang", "run", "label"], "strategy", [s.name for s in STRATEGIES]))


def delta_tag_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Strategies by change, for each tag."""
    rows = _delta(spark, d).select("lang", "run", "label", "strategy", F.round("f1_change", 9).alias("f1_change"))
    return _r(A.ranking(rows, ["lang", "run", "label"], "f1_change", "strategy"))


def macro_f1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.ranking(A.macro_f1(_reports(spark, d), ["lang", "run", "strategy"]).withColumn("macro_f1", F.round("macro_f1", 9)), ["lang", "run"], "macro_f1", "strategy"))


def label_f1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Strategies by F1, for each label that they report."""
    return _r(A.ranking(A.labels_only(_reports(spark, d)).select("lang", "run", "label", "strategy", "f1").distinct(), ["lang", "run", "label"], "f1", "strategy"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_stats").filter("run is not null").distinct()


def strategy_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.ranking(_stats(spark, d).select("lang", "run", "strategy", "accuracy"), ["lang", "run"], "accuracy", "strategy"))


def sentence_accuracy_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.ranking(_stats(spark, d).select("lang", "run", "strategy", "sentence_accuracy"), ["lang", "run"], "sentence_accuracy", "strategy"))


def accuracy_against_time(spark: SparkSession, d: str) -> DataFrame:
    return _r(_stats(spark, d).filter("accuracy is not null and train_seconds is not null").select("lang", "run", "strategy", "accuracy", "train_seconds"))


def mean_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Epochs of a fold, nothing where none were counted."""
    return _stats(spark, d).select("lang", "run", "strategy", F.when(F.col("epochs") > 0, F.expr("epochs div 3")).alias("epochs_per_fold"))


def failed_classes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a strategy has a label with neither precision nor recall, and how many."""
    rows = A.labels_only(_reports(spark, d))
    return rows.groupBy("lang", "run", "strategy").agg(F.bool_or((F.col("precision") == 0) & (F.col("recall") == 0)).alias("failed"), F.count_if((F.col("precision") == 0) & (F.col("recall") == 0)).alias("n_failed"))


def nonzero_pr(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.labels_only(_reports(spark, d)).filter("precision > 0 or recall > 0").select("lang", "run", "strategy", "label", "precision", "recall", "support"))


QUERIES = {
    f.__name__: f
    for f in (
        run_delta, runs_in_both, delta_by_strategy, delta_by_entity_top5, delta_by_entity_bottom5, delta_pivot, delta_tag_ranking, macro_f1_ranking,
        label_f1_ranking, strategy_ranking, sentence_accuracy_ranking, accuracy_against_time, mean_epochs, failed_classes, nonzero_pr,
    )
}

_LABELS = "rep as (select distinct lang, strategy, run, label, precision, recall, f1, support from reports where label is not null and run is not null), lab as (select * from rep where label not in ('accuracy', 'micro avg', 'macro avg', 'weighted avg'))"
_DELTA = f"""with {_LABELS}, have as (select distinct lang, strategy, run from rep),
  d as (select o.lang, o.strategy, o.run + 1 as run, o.label, coalesce(n.precision, 0) - coalesce(o.precision, 0) as precision_change,
               coalesce(n.recall, 0) - coalesce(o.recall, 0) as recall_change, coalesce(n.f1, 0) - coalesce(o.f1, 0) as f1_change
        from lab o join have h on h.lang = o.lang and h.strategy = o.strategy and h.run = o.run + 1
        left join lab n on n.lang = o.lang and n.strategy = o.strategy and n.run = o.run + 1 and n.label = o.label)"""
_ENTITY = _DELTA + ", m as (select lang, run, label, round(avg(f1_change), 9) as f1_change from d group by all)"
_STATS = "with s as (select distinct * from run_stats where run is not null)"


def _place(by: str, value: str) -> str:
    return f"row_number() over (partition by {by} order by {value} desc, strategy desc) as place"


SQL = {
    "run_delta": _DELTA + " select lang, strategy, run, label, round(precision_change, 6) as precision_change, round(recall_change, 6) as recall_change, round(f1_change, 6) as f1_change from d",
    "runs_in_both": _DELTA + " select a.lang, a.strategy, a.run from have a join have b on a.lang = b.lang and a.strategy = b.strategy and a.run = b.run + 1",
    "delta_by_strategy": _DELTA + " select lang, run, strategy, round(avg(f1_change), 6) as f1_change from d group by all",
    "delta_by_entity_top5": _ENTITY + " select lang, run, label, round(f1_change, 6) as f1_change, row_number() over (partition by lang, run order by f1_change desc, label) as rank from m qualify rank <= 5",
    "delta_by_entity_bottom5": _ENTITY + " select lang, run, label, round(f1_change, 6) as f1_change, row_number() over (partition by lang, run order by f1_change, label) as rank from m qualify rank <= 5",
    "delta_pivot": _DELTA + " select lang, run, label, " + ", ".join(f"round(avg(f1_change) filter (where strategy = '{s.name}'), 6) as \"{s.name}\"" for s in STRATEGIES) + " from d group by all",
    "delta_tag_ranking": _DELTA + f", x as (select lang, run, label, strategy, round(f1_change, 9) as f1_change from d) select lang, run, label, strategy, round(f1_change, 6) as f1_change, {_place('lang, run, label', 'x.f1_change')} from x",
    "macro_f1_ranking": f"with {_LABELS}, m as (select lang, run, strategy, round(coalesce(avg(f1), 0), 9) as macro_f1 from lab group by all) select lang, run, strategy, round(macro_f1, 6) as macro_f1, {_place('lang, run', 'm.macro_f1')} from m",
    "label_f1_ranking": f"with {_LABELS}, m as (select distinct lang, run, label, strategy, f1 from lab), z as (select lang, run, label, strategy, coalesce(f1, 0) as f1 from m) select lang, run, label, strategy, round(f1, 6) as f1, {_place('lang, run, label', 'z.f1')} from z",
    "strategy_ranking": _STATS + f", z as (select lang, run, strategy, coalesce(accuracy, 0) as accuracy from s) select lang, run, strategy, round(accuracy, 6) as accuracy, {_place('lang, run', 'z.accuracy')} from z",
    "sentence_accuracy_ranking": _STATS + f", z as (select lang, run, strategy, coalesce(sentence_accuracy, 0) as sentence_accuracy from s) select lang, run, strategy, round(sentence_accuracy, 6) as sentence_accuracy, {_place('lang, run', 'z.sentence_accuracy')} from z",
    "accuracy_against_time": _STATS + " select lang, run, strategy, round(accuracy, 6) as accuracy, round(train_seconds, 6) as train_seconds from s where accuracy is not null and train_seconds is not null",
    "mean_epochs": _STATS + " select lang, run, strategy, case when epochs > 0 then epochs // 3 end as epochs_per_fold from s",
    "failed_classes": f"with {_LABELS} select lang, run, strategy, bool_or(precision = 0 and recall = 0) as failed, count(*) filter (where precision = 0 and recall = 0) as n_failed from lab group by all",
    "nonzero_pr": f"with {_LABELS} select lang, run, strategy, label, round(precision, 6) as precision, round(recall, 6) as recall, support from lab where precision > 0 or recall > 0",
}
