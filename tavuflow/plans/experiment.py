"""The study itself: every language with every strategy, trained and evaluated over folds, written as result files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.config import MIN_SENTENCES, STRATEGIES, TRIAL_STRATEGIES
from tavuflow.operators import crf, embed
from tavuflow.operators import metrics as M
from tavuflow.operators import sequences as S
from tavuflow.operators import tokenize as K
from tavuflow.plans.labels import TAGGED_SQL, tagged
from tavuflow.session import materialize, shared_dir, table
from tavuflow.sources import results

#: Strategies of a kind: how a sentence's labels are predicted.
TASK = "NER"


def sub_tokens(tokens: DataFrame, strategy: str) -> DataFrame:
    """lang, sent_id, pos, word, tag, fold: the sub-tokens of each sentence, numbered anew, each with its word's label."""
    made = K.propagate(tokens.select("lang", "sent_id", F.col("pos").alias("_word_pos"), "token_id", "word", "tag", "fold"), "word", strategy)
    placed = S.position_ratio(made, "sent_id", ["_word_pos", "token_id", "sub_pos"])
    return placed.select("lang", "sent_id", F.col("idx").alias("pos"), F.col("token").alias("word"), "tag", "fold")


def evaluate(tokens: DataFrame, strategy: str, fitted=crf.fit, sample: int = crf.SAMPLE_SENTENCES) -> tuple[DataFrame, DataFrame]:
    """(report, stats) of a strategy by language. report: label, precision, recall, f1 and support, merged over the folds. stats:
    the folds' mean accuracy and sentence accuracy, their seconds and rounds of training summed up."""
    rows = materialize(sub_tokens(tokens, strategy), "sub_tokens")
    # A token's vector is its language's: the same letters in two languages are two tokens.
    own = rows.withColumn("_token", F.concat_ws("\t", "lang", "word"))
    lines = own.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_token"))), lambda x: x["_token"]).alias("tokens"))
    vectors = materialize(embed.vectors(embed.train_word2vec(lines, "tokens")), "vectors")
    features = S.feature_rows(embed.lookup(own, "_token", vectors), "sent_id", ["pos"], "word", "vector")
    sentences = crf.nested(features, ["lang"])
    models = crf.train(sentences, ["lang"], sample, fitted)
    told = materialize(crf.apply(sentences, models, ["lang"]), "predicted")
    report = M.merge_folds(M.report(told, "tag", "pred", ["lang", "fold"]), ["lang"])
    means = [
        M.mean_of_folds(M.accuracy(told, "tag", "pred", ["lang", "fold"]), ["lang"], "accuracy"),
        M.mean_of_folds(M.sentence_accuracy(told, "tag", "pred", "sent_id", ["lang", "fold"]), ["lang"], "sentence_accuracy"),
        models.groupBy("lang").agg(F.sum("seconds").alias("train_seconds"), F.sum(F.size("losses")).alias("epochs")),
    ]
    stats = means[0].join(means[1], "lang").join(means[2], "lang")
    return report, stats


def run(spark: SparkSession, tokens: DataFrame, folds: DataFrame, path: str, number: int = 1, strategies: list[str] | None = None, trial: bool = False, **settings) -> None:
    """A result file of each language and strategy below path. A language of fewer than MIN_SENTENCES sentences is left out.

    Byte-pair strategies are left out unless their sub-words are in the tokens: their vocabularies are not trained here.
    """
    named = [s.name for s in (STRATEGIES[:TRIAL_STRATEGIES] if trial else STRATEGIES) if s.n is not None and (strategies is None or s.name in strategies)]
    enough = tokens.groupBy("lang").agg(F.countDistinct("sent_id").alias("n")).filter(F.col("n") >= MIN_SENTENCES).select("lang")
    kept = materialize(tokens.join(F.broadcast(enough), "lang", "left_semi").join(folds.select("sent_id", "fold"), "sent_id"), "labelled")  # a row for each language
    for strategy in named:
        report, stats = evaluate(kept, strategy, **settings)
        keys = [F.lit(strategy).alias("strategy"), F.lit(number).alias("run"), F.lit(TASK).alias("task")]
        results.write_results(report.select("*", *keys), path, stats.select("*", *keys))


def experiment_reports(spark: SparkSession, d: str) -> DataFrame:
    """Labels and their support in the result files of two strategies."""
    path = f"{shared_dir(spark)}/tavuflow/experiment-{uuid.uuid4().hex}"
    run(spark, tagged(spark, d), table(spark, d, "folds"), path, strategies=["Word", "5grams"])
    found = results.read_results(spark, path)
    stats = results.run_stats(found).filter("accuracy between 0 and 1 and sentence_accuracy between 0 and 1 and train_seconds > 0 and epochs >= 1").select("lang", "strategy", "run")
    return results.reports(found).join(stats, ["lang", "strategy", "run"]).select("lang", "strategy", "run", "task", "label", "support")


QUERIES = {"experiment_reports": experiment_reports}
SQL = {
    "experiment_reports": f"""with {TAGGED_SQL}, s as (select lang, 'Word' as strategy, tag as label, len(list_filter(regexp_split_to_array(word, '[\\s\\x{{a0}}\\x{{3000}}]+'), lambda x: x <> '')) as k from tagged
          union all select lang, '5grams', tag, greatest(length(word) - 4, 0) from tagged)
        select lang, strategy, 1 as run, 'NER' as task, label, sum(k)::bigint as support from s group by all having sum(k) > 0""",
}
