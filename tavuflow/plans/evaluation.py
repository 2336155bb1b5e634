"""Predictions against truth: reports, confusion, accuracy, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.operators import metrics as M
from tavuflow.plans.labels import TOKENS_SQL, tagged
from tavuflow.session import bounded, table


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Each tagged token with pred: the gazetteer's label of a known name, else O; and its sentence's fold."""
    names = table(spark, d, "gazetteer").select("word", F.concat(F.lit("B-"), "label").alias("_named"))
    rows = tagged(spark, d).join(bounded(names), "word", "left").withColumn("pred", F.coalesce("_named", F.lit("O"))).drop("_named")
    return rows.join(table(spark, d, "folds"), "sent_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(predictions(spark, d), "tag", "pred", ["lang"])


def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.report(predictions(spark, d), "tag", "pred", ["lang"]))


def macro_weighted_avg(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.averages(M.report(predictions(spark, d), "tag", "pred", ["lang"]), ["lang"]))


def accuracy_by_fold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.accuracy(predictions(spark, d), "tag", "pred", ["lang", "fold"]))


def sentence_accuracy_by_fold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.sentence_accuracy(predictions(spark, d), "tag", "pred", "sent_id", ["lang", "fold"]))


def mean_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.mean_of_folds(M.accuracy(predictions(spark, d), "tag", "pred", ["lang", "fold"]), ["lang"], "accuracy"))


def fold_merged_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.merge_folds(M.report(predictions(spark, d), "tag", "pred", ["lang", "fold"]), ["lang"]))


PREDICTED_SQL = f"""with {TOKENS_SQL}, p as (
  select t.*, f.fold, coalesce('B-' || g.label, 'O') as pred from toks t left join gazetteer g using (word) join folds f using (sent_id)
  where t.word is not null and t.tag is not null),"""


def _report_sql(by: str) -> str:
    on = " and ".join(f"t.{c} = q.{c}" for c in by.split(", "))
    keys = ", ".join(f"t.{c}" for c in by.split(", "))
    return f"""t as (select {by}, tag as label, count(*) as support, count(*) filter (where tag = pred) as hit from p group by all),
      q as (select {by}, pred as label, count(*) as predicted from p group by all),
      pr as (select {keys}, t.label, t.support, coalesce(hit / predicted, 0) as precision, hit / support as recall from t left join q on {on} and t.label = q.label),
      rep as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from pr)"""


QUERIES = {f.__name__: f for f in (confusion_matrix, classification_report, macro_weighted_avg, accuracy_by_fold, sentence_accuracy_by_fold, mean_accuracy, fold_merged_report)}
_ROUND = "round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1"
SQL = {
    "confusion_matrix": f"{PREDICTED_SQL} z as (select 1) select lang, tag as true_label, pred as pred_label, count(*) as n from p group by all",
    "classification_report": f"{PREDICTED_SQL} {_report_sql('lang')} select lang, label, support, {_ROUND} from rep",
    "macro_weighted_avg": f"{PREDICTED_SQL} {_report_sql('lang')} select lang, sum(support)::bigint as support, "
    + ", ".join(f"round(avg({c}), 6) as macro_{c}, round(sum({c} * support) / sum(support), 6) as weighted_{c}" for c in ("precision", "recall", "f1"))
    + " from rep group by lang",
    "accuracy_by_fold": f"{PREDICTED_SQL} z as (select 1) select lang, fold, round(avg((tag = pred)::int), 6) as accuracy, count(*) as n from p group by all",
    "sentence_accuracy_by_fold": f"{PREDICTED_SQL} s as (select lang, fold, sent_id, bool_and(tag = pred) as ok from p group by all) select lang, fold, round(avg(ok::int), 6) as sentence_accuracy, count(*) as sentences from s group by all",
    "mean_accuracy": f"{PREDICTED_SQL} a as (select lang, fold, avg((tag = pred)::int) as accuracy from p group by all) select lang, round(avg(accuracy), 6) as accuracy from a group by lang",
    "fold_merged_report": f"{PREDICTED_SQL} {_report_sql('lang, fold')} select lang, label, sum(support)::bigint as support, "
    + ", ".join(f"round(sum({c} * support) / sum(support), 6) as {c}" for c in ("precision", "recall", "f1"))
    + " from rep group by all",
}
