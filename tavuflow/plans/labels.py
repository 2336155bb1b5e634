"""Labelled sequences: support, propagation, filters, features, folds."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavuflow.config import STRATEGIES
from tavuflow.functions import vectors as V
from tavuflow.operators import analytics, embed
from tavuflow.operators import sequences as S
from tavuflow.operators import tokenize as K
from tavuflow.session import table

TOKENS_SQL = "toks as (select * from ner_tokens qualify row_number() over (partition by token_id order by loaded_at desc nulls last) = 1)"
TAGGED_SQL = f"{TOKENS_SQL}, tagged as (select * from toks where word is not null and tag is not null)"


def clean_tokens(spark: SparkSession, d: str) -> DataFrame:
    """ner_tokens with each token once, as loaded last."""
    return S.latest(table(spark, d, "ner_tokens"), "token_id", "loaded_at")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return clean_tokens(spark, d).filter("word is not null and tag is not null")


def latest_tokens(spark: SparkSession, d: str) -> DataFrame:
    return clean_tokens(spark, d).select("token_id", "lang", "sent_id", "pos", "word", "tag")


def tag_support_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Sub-tokens of each tag under each strategy."""
    return K.support(tagged(spark, d), "word", ["lang", "tag"])


def propagated_support(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    """The same for one strategy by making the sub-tokens: distinct sub-tokens and their number by tag."""
    made = K.propagate(tagged(spark, d).select("lang", "tag", "word"), "word", strategy)
    return made.groupBy("lang", "tag").agg(F.count("*").alias("support"), F.countDistinct("token").alias("distinct_tokens"))


def propagated_tokens_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent bigrams of each tag."""
    made = K.propagate(tagged(spark, d).select("tag", "word"), "word", "Bigrams").groupBy("tag", "token").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "token"))
    return made.withColumn("place", place.cast("long")).filter("place <= 10")


def ngram_vanished_words(spark: SparkSession, d: str) -> DataFrame:
    return K.vanished(tagged(spark, d), "word", ["lang"])


def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    found = analytics.histogram(clean_tokens(spark, d), "tag", "token_id", ["lang"])
    return found.withColumn("place", F.col("place").cast("long"))


def sentence_filter_all_outside(spark: SparkSession, d: str) -> DataFrame:
    return S.with_entities(clean_tokens(spark, d), "sent_id", "tag").select("token_id", "sent_id")


def sentence_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.sentence_lines(tagged(spark, d), "sent_id", "pos", "word", "tag")


def position_ratio(spark: SparkSession, d: str) -> DataFrame:
    found = S.position_ratio(tagged(spark, d), "sent_id", ["pos", "token_id"])
    return found.select("token_id", F.col("idx").cast("long").alias("idx"), "length", "ratio")


def language_guard(spark: SparkSession, d: str) -> DataFrame:
    """Languages with sentences enough for the folds."""
    return clean_tokens(spark, d).groupBy("lang").agg(F.countDistinct("sent_id").alias("sentences")).filter("sentences >= 5")


def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Train and test sizes of each fold: a sentence is tested in its own fold and trained on in the others."""
    rows = clean_tokens(spark, d).join(table(spark, d, "folds"), "sent_id")
    sizes = rows.groupBy("lang", "fold").agg(F.count("*").alias("test_tokens"), F.countDistinct("sent_id").alias("test_sentences"))
    whole = Window.partitionBy("lang")
    return sizes.select("lang", "fold", "test_tokens", "test_sentences", (F.sum("test_tokens").over(whole) - F.col("test_tokens")).alias("train_tokens"))


def lowercase_tags(spark: SparkSession, d: str) -> DataFrame:
    """Label ids in alphabetic order, and distinct lower-cased words of each label."""
    labels = tagged(spark, d).groupBy("tag").agg(F.countDistinct(F.lower("word")).alias("n_lower"))
    return labels.select("tag", "n_lower", (F.row_number().over(Window.orderBy("tag")) - 1).cast("long").alias("label_id"))


def label_union(spark: SparkSession, d: str) -> DataFrame:
    """All labels that any source knows."""
    return table(spark, d, "label_set").select("tag").union(table(spark, d, "ner_tokens").select("tag")).filter("tag is not null").distinct()


def embedding_bucketize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.buckets(F.col("embedding"))).alias("dim", "bucket"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), "bucket")


def context_similarity(spark: SparkSession, d: str) -> DataFrame:
    found = S.context_similarity(table(spark, d, "embeddings"), "label", ["vec_id"], "embedding")
    return found.select("vec_id", F.col("offset").cast("long").alias("offset"), "similarity")


def embedding_lookup_default_zero(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct word with the norm of its vector, 0 for words without one. Gazetteer entries lend their words to vectors."""
    words = tagged(spark, d).select("word").distinct()
    entries = table(spark, d, "gazetteer").select("entry_id", "word").join(table(spark, d, "embeddings"), F.col("entry_id") == F.col("vec_id"))
    found = embed.lookup(words, "word", entries.select(F.col("word").alias("token"), F.col("embedding").alias("vector")), 64)
    return found.select("word", F.size("vector").cast("long").alias("dims"), F.round(V.norm(F.col("vector")), 6).alias("norm"))


def train_test_split_90_10(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and tokens on each side of the split."""
    rows = S.split_by_hash(clean_tokens(spark, d), "sent_id")
    return rows.groupBy("split").agg(F.count("*").alias("n_tokens"), F.countDistinct("sent_id").alias("sentences"))


def compat_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Support of 5grams by tag when empty sentences shift the embeddings, beside the right pairing."""
    words = tagged(spark, d)
    sizes = words.groupBy("sent_id", "tag").agg(F.sum(F.greatest(F.char_length("word") - 4, F.lit(0))).alias("k"))
    have = sizes.groupBy("sent_id").agg(F.sum("k").alias("k")).filter("k > 0")
    out = None
    for mode in ("correct", "compat"):
        pairs = S.paired(words, have, "sent_id", mode)
        lengths = have.select(F.col("sent_id").alias("embedded_sent"), F.col("k").alias("n_vectors"))
        mine = sizes.groupBy("sent_id").agg(F.sum("k").alias("n_tokens"))
        used = pairs.join(lengths, "embedded_sent").join(mine, "sent_id")
        part = used.agg(F.lit(mode).alias("mode"), F.count("*").alias("sentences"), F.sum(F.least("n_tokens", "n_vectors")).alias("support"))
        out = part if out is None else out.union(part)
    return out.select("mode", "sentences", "support")


_STRATS = " union all ".join(f"select '{s.name}' as strategy, {s.n} as n" for s in STRATEGIES if s.n is not None)
_GRAMS = "unnest(list_transform(range(1, length(word) - {n} + 2), lambda i: substring(word, i::int, {n}))) as token"

QUERIES = {
    "tag_support_by_strategy": tag_support_by_strategy,
    "latest_tokens": latest_tokens,
    "propagated_support_bigrams": partial(propagated_support, strategy="Bigrams"),
    "propagated_support_5grams": partial(propagated_support, strategy="5grams"),
    "propagated_tokens_topk": propagated_tokens_topk,
    "ngram_vanished_words": ngram_vanished_words,
    "label_histogram": label_histogram,
    "sentence_filter_all_outside": sentence_filter_all_outside,
    "sentence_lines": sentence_lines,
    "position_ratio": position_ratio,
    "language_guard": language_guard,
    "fold_sizes": fold_sizes,
    "lowercase_tags": lowercase_tags,
    "label_union": label_union,
    "embedding_bucketize": embedding_bucketize,
    "context_similarity": context_similarity,
    "embedding_lookup_default_zero": embedding_lookup_default_zero,
    "train_test_split_90_10": train_test_split_90_10,
    "compat_pairing": compat_pairing,
}
SQL = {
    "tag_support_by_strategy": f"with {TAGGED_SQL}, s as ({_STRATS}) select lang, tag, strategy, sum(case when n = 0 then 1 else greatest(length(word) - n + 1, 0) end)::bigint as support from tagged, s group by all",
    "latest_tokens": f"with {TOKENS_SQL} select token_id, lang, sent_id, pos, word, tag from toks",
    "propagated_support_bigrams": f"with {TAGGED_SQL}, g as (select lang, tag, {_GRAMS.format(n=2)} from tagged) select lang, tag, count(*) as support, count(distinct token) as distinct_tokens from g group by all",
    "propagated_support_5grams": f"with {TAGGED_SQL}, g as (select lang, tag, {_GRAMS.format(n=5)} from tagged) select lang, tag, count(*) as support, count(distinct token) as distinct_tokens from g group by all",
    "propagated_tokens_topk": f"with {TAGGED_SQL}, g as (select tag, {_GRAMS.format(n=2)} from tagged), c as (select tag, token, count(*) as n from g group by all) select tag, token, n, row_number() over (partition by tag order by n desc, token) as place from c qualify place <= 10",
    "ngram_vanished_words": f"with {TAGGED_SQL} select lang, n::int as n, count(*) filter (where length(word) < n) as vanished from tagged, (select unnest([2, 3, 4, 5]) as n) group by all",
    "label_histogram": f"with {TOKENS_SQL}, c as (select lang, tag, count(*) as n, min(token_id) as first_at from toks where tag is not null group by all) select lang, tag, n, first_at, row_number() over (partition by lang order by n desc, first_at) as place from c",
    "sentence_filter_all_outside": f"with {TOKENS_SQL} select token_id, sent_id from toks where sent_id in (select sent_id from toks where tag <> 'O')",
    "sentence_lines": f"with {TAGGED_SQL} select sent_id, string_agg(word || chr(9) || tag, chr(10) order by pos, word, tag) as block from tagged group by sent_id",
    "position_ratio": f"with {TAGGED_SQL}, x as (select token_id, row_number() over (partition by sent_id order by pos, token_id) - 1 as idx, count(*) over (partition by sent_id) as length from tagged) select token_id, idx, length, round(idx / length, 2) as ratio from x",
    "language_guard": f"with {TOKENS_SQL} select lang, count(distinct sent_id) as sentences from toks group by lang having count(distinct sent_id) >= 5",
    "fold_sizes": f"with {TOKENS_SQL}, s as (select lang, fold, count(*) as test_tokens, count(distinct sent_id) as test_sentences from toks join folds using (sent_id) group by all) select lang, fold, test_tokens, test_sentences, (sum(test_tokens) over (partition by lang) - test_tokens)::bigint as train_tokens from s",
    "lowercase_tags": f"with {TAGGED_SQL}, c as (select tag, count(distinct lower(word)) as n_lower from tagged group by tag) select tag, n_lower, row_number() over (order by tag) - 1 as label_id from c",
    "label_union": "select tag from label_set union select tag from ner_tokens where tag is not null",
    "embedding_bucketize": "with e as (select vec_id, unnest(range(15)) as dim, unnest(embedding[1:15]) as x from embeddings) select vec_id, dim, case when x::double > 0.3 then 'high' when x::double < -0.3 then 'low' else 'mid' end as bucket from e",
    "context_similarity": """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v, row_number() over (partition by label order by vec_id) as i from embeddings),
        p as (select a.vec_id, b.i - a.i as "offset", list_cosine_similarity(a.v, b.v) as s from e a join e b on a.label = b.label and b.i - a.i between -5 and 5 and b.i <> a.i)
        select vec_id, "offset", round(s, 3) as similarity from p where abs(s) > 0.1""",
    "embedding_lookup_default_zero": f"""with {TAGGED_SQL}, w as (select distinct word from tagged),
        v as (select word, list_transform(embedding, lambda x: x::double) as v from gazetteer join embeddings on entry_id = vec_id)
        select w.word, 64::bigint as dims, round(coalesce(sqrt(list_sum(list_transform(v, lambda x: x * x))), 0), 6) as norm from w left join v using (word)""",
    "train_test_split_90_10": f"""with {TOKENS_SQL}, b as (select sent_id, ('0x' || substring(md5('42:' || sent_id), 1, 12))::bigint % 10000 as k from toks)
        select case when k < 9000 then 'train' else 'test' end as split, count(*) as n_tokens, count(distinct sent_id) as sentences from b group by all""",
    "compat_pairing": f"""with {TAGGED_SQL}, m as (select sent_id, sum(greatest(length(word) - 4, 0)) as n_tokens from tagged group by sent_id),
        h as (select sent_id, n_tokens as n_vectors, row_number() over (order by sent_id) as i from m where n_tokens > 0),
        e as (select sent_id, n_tokens, row_number() over (order by sent_id) as i from m)
        select 'correct' as mode, count(*) as sentences, sum(n_vectors)::bigint as support from h
        union all select 'compat', count(*), sum(least(n_tokens, n_vectors))::bigint from e join h using (i)""",
}
