"""Queries that train models; the rows of trained models are checked by tests, not by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.functions import text as T
from tavuflow.functions import vectors as V
from tavuflow.operators import bpe, crf, embed, tagger
from tavuflow.operators import metrics as M
from tavuflow.operators import sequences as S
from tavuflow.plans.labels import TAGGED_SQL as _TAGGED
from tavuflow.plans.labels import tagged
from tavuflow.plans.tokens import SQL_SPACE
from tavuflow.session import bounded, materialize, shared_dir, spread, table

#: The public vocabulary whose merges the BPE queries use.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def bpe_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Sub-words of the articles' words and their number. Distinct words are encoded, weighted by their counts."""
    merges, _ = bpe.read_vocabulary_file(spark, VOCABULARY)
    made = bpe.encode_words(article_words(spark, d), "word", bpe.merger(spark, merges))
    return made.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


def article_words(spark: SparkSession, d: str) -> DataFrame:
    """The distinct lower-cased words of the articles and their counts: all that byte-pair training or encoding needs to see."""
    text = spread(table(spark, d, "articles").select("Cleaned_Text"))
    return text.select(F.explode(T.words(F.lower("Cleaned_Text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def bpe_corpus(spark: SparkSession, d: str) -> DataFrame:
    return article_words(spark, d)


def bpe_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pair_counts(article_words(spark, d), "word", "n")


def bpe_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return bpe.read_vocabulary_file(spark, VOCABULARY)[1]


def _lines(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("tokens"))


def word2vec_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Words of the labelled sentences with their vectors' size and whether their norm is sound, from a model that was saved."""
    sound = lambda n: (n > 0) & ~F.isnan(n) & (n < 1e6)
    path = f"{shared_dir(spark)}/tavuflow/model-{uuid.uuid4().hex}"
    embed.save_model(embed.train_word2vec(_lines(tagged(spark, d)), "tokens"), path)
    return embed.vectors(embed.load_model(path)).select("token", F.size("vector").cast("long").alias("dims"), sound(V.norm(F.col("vector"))).alias("sound"))


def _with_folds(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).join(table(spark, d, "folds"), "sent_id").select("lang", "sent_id", "pos", "token_id", "word", "tag", "fold")


def _features(spark: SparkSession, d: str) -> DataFrame:
    """The tokens with the features of their trained vectors and neighbours."""
    rows = materialize(_with_folds(spark, d), "tagged")
    vectors = materialize(embed.vectors(embed.train_word2vec(_lines(rows), "tokens")), "vectors")
    return S.feature_rows(embed.lookup(rows, "word", vectors), "sent_id", ["pos", "token_id"], "word", "vector")


def crf_features(spark: SparkSession, d: str) -> DataFrame:
    """What a token's features are made of: the place, the buckets and the similarities. Each word borrows a vector by a digest."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    n = vectors.count()
    digest = F.conv(F.substring(F.md5(F.lower("word")), 1, 12), 16, 10).cast("long")
    rows = tagged(spark, d).select("token_id", "sent_id", "pos", "word").withColumn("_v", F.pmod(digest, F.lit(max(n, 1))))
    made = S.feature_rows(rows.join(bounded(vectors), "_v", "left").drop("_v"), "sent_id", ["pos", "token_id"], "word", "embedding")
    of = lambda start: F.filter("features", lambda x: x["name"].startswith(start))
    near = of("context_")
    return made.select(
        "token_id",
        F.substring(of("token.lower=")[0]["name"], 13, 1_000_000).alias("lower_word"),
        of("position_ratio")[0]["value"].alias("position_ratio"),
        F.array_join(F.transform(of("emb_dim_"), lambda x: F.regexp_extract(x["name"], "=(.)", 1)), "").alias("buckets"),
        F.transform(near, lambda x: F.regexp_extract(x["name"], "_(-?[0-9]+)_", 1).cast("long")).alias("offsets"),
        F.transform(near, lambda x: x["value"]).alias("similarities"),
    )


def _scored(rows: DataFrame, by: list[str]) -> DataFrame:
    return M.merge_folds(M.report(rows, "tag", "pred", [*by, "fold"]), by)


def lr_tagger_eval(spark: SparkSession, d: str) -> DataFrame:
    """Report of a log-linear model over all rows of the other folds."""
    return _scored(tagger.cross_validate(materialize(_with_folds(spark, d), "tagged"), rounds=500), [])


def crf_tagger_eval(spark: SparkSession, d: str) -> DataFrame:
    """Report by language of a field fitted on a bounded sample of each fold's sentences."""
    return _scored(crf.cross_validate(_features(spark, d), ["lang"]), ["lang"])


def sgd_tagger_eval(spark: SparkSession, d: str) -> DataFrame:
    """Report by language of a log-linear model whose epochs end when the loss no longer falls."""
    return _scored(crf.cross_validate(_features(spark, d), ["lang"], fitted=crf.fit_sgd), ["lang"])


def sgd_training_runs(spark: SparkSession, d: str) -> DataFrame:
    """The losses of each epoch, and what the folds of a language sum up to: epochs, sentences and whether each run stopped where
    its losses say that it should."""
    models = crf.train(crf.nested(_features(spark, d), ["lang"]), ["lang"], fitted=crf.fit_sgd)
    losses = models.select("lang", "held_out", F.posexplode("losses").alias("epoch", "loss"))
    stops = M.early_stop(losses, ["lang", "held_out"], "epoch", "loss")
    runs = models.join(stops, ["lang", "held_out"])
    right = (F.size("losses") == 500) & F.col("stop_epoch").isNull() | (F.size("losses") == F.col("stop_epoch") + 1)
    return M.sum_of_folds(runs.select("lang", "sentences", F.size("losses").cast("long").alias("epochs"), right.alias("right"), F.col("losses")[0].alias("first"), "best"), ["lang"])


def crf_top_weights(spark: SparkSession, d: str) -> DataFrame:
    """The ten state features of most weight of each language and fold."""
    features = materialize(_features(spark, d), "features")
    models = crf.train(crf.nested(features, ["lang"]), ["lang"])
    top = crf.top_of(models, ["lang"])
    names = features.select(F.explode("features.name").alias("feature")).distinct().withColumn("column", crf.column_of(F.col("feature")))
    named = names.join(F.broadcast(top), "column").groupBy("lang", "held_out", "place", "label", "weight").agg(F.min("feature").alias("feature"))  # ten rows for each model
    return named.select("lang", "held_out", "place", "feature", "label", F.round("weight", 6).alias("weight"))


_BORROWED = f"""with {_TAGGED}, w as (
    select token_id, sent_id, lower(replace(word, 'İ', 'i̇')) as lw, row_number() over (partition by sent_id order by pos, token_id) - 1 as i, count(*) over (partition by sent_id) as n,
           ('0x' || substring(md5(lower(replace(word, 'İ', 'i̇'))), 1, 12))::bigint % (select count(*) from embeddings) as v from tagged),
  e as (select w.*, list_transform(embedding, lambda x: x::double) as x from w left join embeddings on vec_id = v),
  p as (select a.token_id, b.i - a.i as o, list_cosine_similarity(a.x, b.x) as s from e a join e b on a.sent_id = b.sent_id and b.i - a.i between -5 and 5 and b.i <> a.i),
  s as (select token_id, list(o order by o) as offsets, list(round(s, 3) order by o) as similarities from p where abs(s) > 0.1 group by token_id)"""

QUERIES = {
    f.__name__: f
    for f in (bpe_tokens, bpe_corpus, bpe_pair_counts, bpe_vocabulary, word2vec_vectors, crf_features, lr_tagger_eval, crf_tagger_eval, sgd_tagger_eval, sgd_training_runs, crf_top_weights)
}
_WORDS = f"""with w as (select unnest(list_filter(regexp_split_to_array(lower(replace(Cleaned_Text, 'İ', 'i̇')), '{SQL_SPACE}'), lambda x: x <> '')) as word from articles where Cleaned_Text is not null),
  c as (select word, count(*) as n from w group by word)"""
# A symbol stands between two marks, so that a pair is merged by replacing a string.
_SYMBOLS = "regexp_extract_all(s, chr(1) || '([^' || chr(2) || ']*)' || chr(2), 1)"
_MERGED = f"""{_WORDS.replace('with w as', 'with recursive w as', 1)},
  merges as (select unnest(range(len(ms))) as rank, unnest(ms) as pair from (select from_json(json_extract(content, '$.model.merges'), '[["VARCHAR"]]') as ms from read_text('{VOCABULARY}'))),
  steps as (select word, array_to_string(list_transform(range(1, length(word) + 1), lambda i: chr(1) || substring(word, i::int, 1) || case when i = length(word) then '</w>' else '' end || chr(2)), '') as s, 0 as k from c
    union all
    select word, replace(s, chr(1) || pair[1] || chr(2) || chr(1) || pair[2] || chr(2), chr(1) || pair[1] || pair[2] || chr(2)), k + 1 from (
      select word, s, k, min_by(merges.pair, merges.rank) as pair
      from (select word, s, k, unnest(list_transform(list_zip(y[:-2], y[2:]), lambda z: [z[1], z[2]])) as pair from (select word, s, k, {_SYMBOLS} as y from steps) where len(y) > 1) x
      join merges on merges.pair = x.pair group by word, s, k)),
  ended as (select word, arg_max(s, k) as s from steps group by word)"""
SQL = {
    "bpe_tokens": f"{_MERGED}, t as (select unnest({_SYMBOLS}) as token, n from ended join c using (word)) select token, sum(n)::bigint as n from t group by token",
    "bpe_corpus": f"{_WORDS} select word, n from c",
    "bpe_pair_counts": f"""{_WORDS}, p as (select unnest(list_transform(range(1, length(word)), lambda i: struct_pack(l := substring(word, i::int, 1), r := substring(word, i::int + 1, 1)))) as p, n from c)
        select p.l as "left", p.r as "right", sum(n)::bigint as n from p group by all""",
    "bpe_vocabulary": f"select v.value::int as id, v.key as token from (select unnest(map_entries(from_json(json_extract(content, '$.model.vocab'), '\"MAP(VARCHAR, INTEGER)\"'))) as v from read_text('{VOCABULARY}'))",
    "word2vec_vectors": f"with {_TAGGED} select distinct word as token, 100::bigint as dims, true as sound from tagged",
    "crf_features": f"""{_BORROWED} select e.token_id, lw as lower_word, round(i / n, 2) as position_ratio,
        array_to_string(list_transform(x[1:15], lambda y: case when y > 0.3 then 'h' when y < -0.3 then 'l' else 'm' end), '') as buckets,
        coalesce(offsets, []) as offsets, coalesce(similarities, []) as similarities from e left join s using (token_id)""",
}
