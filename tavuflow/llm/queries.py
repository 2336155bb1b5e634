"""The queries of the problems in this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.functions import text as T
from tavuflow.llm import budget, bytebpe, langnames, language, lookalike, neardup, packing, quality, sentences, terms, unigram
from tavuflow.session import bounded, materialize, table

CAPACITY = 2048


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    words = lookalike.same_look_words(table(spark, d, "ner_tokens"), "token_id", "word", table(spark, d, "gazetteer"), "entry_id", "word")
    texts = lookalike.same_look_pairs(table(spark, d, "articles"), "article_id", "Cleaned_Text")
    return words.select(F.lit("word").alias("kind"), "id_a", "id_b").union(texts.select(F.lit("text").alias("kind"), "id_a", "id_b"))


def p3_text_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each article with a text, the least article that looks the same, and the number of spellings among them."""
    return lookalike.same_look_classes(table(spark, d, "articles"), "article_id", "Cleaned_Text").withColumnRenamed("id", "article_id")


def p3_consistent_text(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, d, "articles").select("article_id", "Cleaned_Text"), "Cleaned_Text").select("article_id", "consistent")


def p3_consistent_words(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, d, "ner_tokens").select("token_id", "word"), "word").distinct()


def term_records(spark: SparkSession, d: str) -> DataFrame:
    """(scope, terms): the articles' words and the tokens of each strategy, each record once."""
    texts = table(spark, d, "articles").filter("Cleaned_Text is not null").select(F.lit("text").alias("scope"), terms.split_terms(F.col("Cleaned_Text")).alias("terms"))
    lines = terms.first_rows(table(spark, d, "tokenized").select("line_id", "strategy", "tokens", "tokenized_at"), "line_id", [F.col("tokenized_at"), F.col("strategy")], "tokens")
    return texts.union(lines.select(F.col("strategy").alias("scope"), F.col("tokens").alias("terms")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(term_records(spark, d)).filter("mark is not null").select("scope", "term", "mark")


def p5_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(term_records(spark, d)).select("scope", "term", "n", "records", "mark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_duplicates(table(spark, d, "articles"), "article_id", "Cleaned_Text")
    return neardup.record_pairs(members, links).select(F.col("id_a").alias("article_id_a"), F.col("id_b").alias("article_id_b"))


def _near_articles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    members, links = neardup.near_duplicates(table(spark, d, "articles"), "article_id", "Cleaned_Text")
    return members, materialize(links, "links")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """article_id, group_id (the least article_id of its group) and n_links (texts that its text is linked with, copies aside)."""
    members, links = _near_articles(spark, d)
    named = materialize(neardup.groups(members, links).withColumnRenamed("id", "article_id"), "groups")
    least = named.groupBy("group_id").agg(F.min("article_id").alias("_least"))
    degree = links.select("fp_a", "fp2_a").union(links.select("fp_b", "fp2_b")).toDF("fp", "fp2").groupBy("fp", "fp2").agg(F.count("*").alias("n_links"))
    counted = members.join(bounded(degree), ["fp", "fp2"], "left").select(F.col("id").alias("article_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return named.join(bounded(least), "group_id").select("article_id", F.col("_least").alias("group_id")).join(counted, "article_id").distinct()


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """The links between different texts, each named by its least article: Jaccard similarity, and the edits of the alignment with
    the edit similarity that follows (null if they are more than the band holds)."""
    members, links = _near_articles(spark, d)
    heads = bounded(members.groupBy("fp", "fp2").agg(F.min("id").alias("id"), F.min("n_words").alias("n_words")))
    for s in "ab":
        links = links.join(heads.toDF(f"fp_{s}", f"fp2_{s}", f"id_{s}", f"words_{s}"), [f"fp_{s}", f"fp2_{s}"])
    edit = 1 - F.col("edits") / F.greatest("words_a", "words_b")
    return links.select(F.least("id_a", "id_b").alias("article_id_a"), F.greatest("id_a", "id_b").alias("article_id_b"), "similarity", "edits", edit.alias("edit_similarity"))


def p7_token_budget(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles").select("article_id", "source", langnames.language_code(F.col("lang")).alias("language"), "topic", "Cleaned_Text")
    counted = materialize(bytebpe.token_counts(articles, "Cleaned_Text", bytebpe.vocabulary_path()), "counts")
    return budget.budget(counted, "article_id", "n_tokens", ["source", "language", "topic"])


def p7_unigram_budget(spark: SparkSession, d: str) -> DataFrame:
    """The same by best paths over the pieces of a vocabulary that has scores."""
    articles = table(spark, d, "articles").select("article_id", "source", langnames.language_code(F.col("lang")).alias("language"), "topic", "Cleaned_Text")
    trie = unigram.DoubleArrayTrie(*unigram.scored_pieces(f"{bytebpe.DEFAULT_DIR}/piece_bpe_32k.model"))
    counted = materialize(unigram.counts(articles, "Cleaned_Text", trie), "counts")
    return budget.budget(counted, "article_id", "n_tokens", ["source", "language", "topic"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bytebpe.token_ids(table(spark, d, "documents").select("doc_id", "text"), "text", bytebpe.vocabulary_path())


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    counted = bytebpe.token_counts(table(spark, d, "documents").select("doc_id", "text"), "text", bytebpe.vocabulary_path())
    return packing.pack(counted, "doc_id", "n_tokens", CAPACITY)


def typed_articles(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and type of each article."""
    return quality.text_types(table(spark, d, "articles"), "article_id", "Cleaned_Text", langnames.language_code(F.col("lang")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return typed_articles(spark, d).filter("n_lines > 0 and prose < 0.5").select("article_id").distinct()


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """What a title tells: its words and characters, and whether the text begins with it or holds it."""
    title, text = (T.strip(F.col(c)) for c in ("Title", "Cleaned_Text"))
    known = F.coalesce(title != "", F.lit(False))
    place = F.coalesce(F.expr("locate(_title, _text)"), F.lit(0))
    rows = table(spark, d, "articles").select("article_id", F.col("Title").alias("title"), title.alias("_title"), text.alias("_text"), known.alias("_known"))
    return rows.select(
        "article_id", "title",
        F.coalesce(F.size(T.words(F.col("_title"))), F.lit(0)).cast("long").alias("title_words"),
        F.coalesce(F.char_length("_title"), F.lit(0)).cast("long").alias("title_chars"),
        (F.col("_known") & (place == 1)).alias("title_first"),
        (F.col("_known") & (place > 0)).alias("title_in_text"),
    )


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return typed_articles(spark, d).join(_titles(spark, d), "article_id")


def p1_text_counts(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that need no model: of the text by the operator's scan, of the title beside it."""
    none = F.lit(None).cast("string")
    rows = quality.line_patterns(table(spark, d, "articles"), "article_id", "Cleaned_Text", none, np.zeros(0, np.uint64), [])
    shares = [F.round(c, 6).alias(c) for c in ("mean_word_length", "digit_ratio", "ending_share")]
    return rows.select(F.col("key").alias("article_id"), "n_chars", "n_lines", "n_words", *shares).join(_titles(spark, d).drop("title"), "article_id")


def labelled_articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("article_id", langnames.language_code(F.col("lang")).alias("label"), "Cleaned_Text")


def long_prose(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The articles of at least 200 characters, and the keys of those that are prose: what p2_found tells and a model is fitted on."""
    prose = materialize(typed_articles(spark, d).filter("prose >= 0.5").select("article_id"), "prose")
    return labelled_articles(spark, d).filter(F.length("Cleaned_Text") >= 200), bounded(prose)


def language_model(long: DataFrame, prose: DataFrame) -> language.Model:
    return language.fit(*language.sample_texts(long.join(prose, "article_id", "left_semi"), "article_id", "Cleaned_Text", "label"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    long, prose = long_prose(spark, d)
    told = language.identify(long.select("article_id", "Cleaned_Text"), "article_id", "Cleaned_Text", language_model(long, prose))
    told = told.join(prose, "article_id", "left_semi").join(labelled_articles(spark, d).select("article_id", "label"), "article_id")
    told = materialize(told, "languages").filter("language is not null")
    main = told.filter("label is null or label <> language").select("article_id", F.lit(-1).alias("line_no"), F.col("language").alias("lang"))
    lines = told.select("article_id", F.explode("segments").alias("s")).select("article_id", "s.line_no", F.col("s.language").alias("lang"))
    return main.union(lines).distinct()


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """article_id, label, language, confidence and segments, those of one sentence too, of every article."""
    articles = labelled_articles(spark, d)
    told = language.identify(articles.select("article_id", "Cleaned_Text"), "article_id", "Cleaned_Text", language_model(*long_prose(spark, d)), together=1)
    return told.join(articles.select("article_id", "label"), "article_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.units(table(spark, d, "documents"), "doc_id", "text", with_text=False).distinct()


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.units(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p2_found, p3_found, p5_found, p6_found, p7_token_budget, p8_ids, p9_packing, p10_found, p1_statistics, p7_unigram_budget, p2_languages, p3_consistent_text, p3_consistent_words, p3_text_classes, p5_term_counts, p6_groups, p6_links, p1_text_counts, p10_sentences]
    return {f.__name__: f for f in found}
