"""Tokenisation, sampling and corpus queries over articles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.config import experiments
from tavuflow.functions import text as T
from tavuflow.operators import sampling
from tavuflow.operators import tokenize as K
from tavuflow.session import spread, table

_TEXT = "Cleaned_Text"
# DuckDB's spelling of the white space class.
SQL_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LINES = "lines_ as (select article_id, unnest(str_split(Cleaned_Text, chr(10))) as line from articles)"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{SQL_SPACE}|{SQL_SPACE}$', '', 'g')"



def token_counts(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return K.token_counts(spread(table(spark, d, "articles").select(_TEXT)), _TEXT, strategy)


def line_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each article with their words and characters."""
    lines = K.lines(table(spark, d, "articles"), _TEXT, ["article_id"])
    return lines.select("article_id", F.col("line_no").cast("long").alias("line_no"), F.size(T.words(F.col("line"))).cast("long").alias("n_words"), F.char_length("line").cast("long").alias("n_chars"))


def retokenized(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the tokenized table whose stored tokens differ from tokenising their text again, by strategy."""
    rows = table(spark, d, "tokenized").filter("tokens is not null")
    again = F.coalesce(*[F.when(F.col("strategy") == s, K.tokenizer(s)(F.col("text"))) for s in ("Word", "Bigrams", "Char")])
    return rows.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if(again == F.col("tokens")).alias("same"))


def tiered_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.tiered_sample(spread(table(spark, d, "articles").select("article_id", "pos", "Title", _TEXT)), "Title", _TEXT, "pos").select("article_id", "Title", "tier", F.col("ordinal").cast("long").alias("ordinal"))


def tiered_sample_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("article_id", "pos", "source", "Title", _TEXT)
    return sampling.tiered_sample(rows, "Title", _TEXT, "pos", target=50, group="source").select("source", "article_id", "tier", F.col("ordinal").cast("long").alias("ordinal"))


def size_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.clean_articles(table(spark, d, "articles").select("article_id", "Title", _TEXT), "Title", _TEXT)
    return rows.select("article_id", T.byte_size(F.col(_TEXT)).cast("long").alias("bytes")).filter("bytes >= 1024")


def title_slug(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").filter("Title is not null")
    return rows.select("article_id", T.title_slug(F.col("Title")).alias("slug"), T.article_name(F.col("article_id"), F.col("Title")).alias("file_name"))


def article_body(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.clean_articles(table(spark, d, "articles").select("article_id", "Title", _TEXT), "Title", _TEXT)
    body = T.article_body(F.col("Title"), F.col(_TEXT))
    return rows.select("article_id", F.md5(body).alias("body_md5"), F.char_length(body).cast("long").alias("n_chars"))


def article_counters(spark: SparkSession, d: str) -> DataFrame:
    """Pages read, valid articles and distinct titles by source."""
    strip = lambda c: T.strip(F.col(c))
    rows = table(spark, d, "articles").select("source", strip("Title").alias("t"), strip(_TEXT).alias("x"))
    valid = F.coalesce((F.col("t") != "") & (F.col("x") != ""), F.lit(False))
    return rows.groupBy("source").agg(F.count("*").alias("pages"), F.count_if(valid).alias("valid"), F.countDistinct(F.when(valid, F.col("t"))).alias("titles"))


def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    return experiments(spark)


def word_frequency_by_language(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent words of each label."""
    from pyspark.sql import Window

    words = K.line_tokens(table(spark, d, "articles").filter("lang is not null"), _TEXT, "Word", ["lang"])
    counts = words.groupBy("lang", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))
    return counts.withColumn("place", rank).filter("place <= 10").withColumn("place", F.col("place").cast("long"))


def _ngram_sql(n: int) -> str:
    return f"with {_LINES}, g as (select unnest(list_transform(range(1, length(line) - {n} + 2), lambda i: substring(line, i::int, {n}))) as token from lines_) select token, count(*) as n from g group by token"


CLEAN_SQL = f"clean as (select article_id, pos, source, {_strip('Title')} as t, {_strip('Cleaned_Text')} as x from articles)"
_SLUG = f"regexp_replace(substring(array_to_string(list_filter(regexp_split_to_array(Title, '{SQL_SPACE}'), lambda w: w <> ''), '_'), 1, 50), '[<>:\"/\\\\|?*]', '_', 'g')"
_TIERED = "with " + CLEAN_SQL.replace("{", "{{").replace("}", "}}") + """, tiers as (select *, least(4, floor(strlen(x) / 1024))::int as tier from clean where t <> '' and x <> ''),
  firsts as (select * from tiers where tier >= 1 qualify row_number() over (partition by {by} t order by tier desc, pos) = 1)"""
_NGRAMS = {"char_token_counts": ("Char", 1), "bigram_counts": ("Bigrams", 2), "trigram_counts": ("Trigrams", 3), "fourgram_counts": ("4grams", 4), "fivegram_counts": ("5grams", 5)}

QUERIES = {
    "word_token_counts": partial(token_counts, strategy="Word"),
    **{name: partial(token_counts, strategy=s) for name, (s, _) in _NGRAMS.items()},
    "line_lengths": line_lengths,
    "retokenized": retokenized,
    "tiered_sample": tiered_sample,
    "tiered_sample_by_source": tiered_sample_by_source,
    "size_filter": size_filter,
    "title_slug": title_slug,
    "article_body": article_body,
    "article_counters": article_counters,
    "experiment_grid": experiment_grid,
    "word_frequency_by_language": word_frequency_by_language,
}
SQL = {
    "word_token_counts": f"with {_LINES}, w as (select unnest(list_filter(regexp_split_to_array(line, '{SQL_SPACE}'), lambda x: x <> '')) as token from lines_) select token, count(*) as n from w group by token",
    **{name: _ngram_sql(n) for name, (_, n) in _NGRAMS.items()},
    "line_lengths": f"""with l as (select article_id, str_split(Cleaned_Text, chr(10)) as ls from articles where Cleaned_Text is not null),
        e as (select article_id, unnest(range(len(ls))) as line_no, unnest(ls) as line from l)
        select article_id, line_no, len(list_filter(regexp_split_to_array(line, '{SQL_SPACE}'), lambda x: x <> ''))::bigint as n_words, length(line)::bigint as n_chars from e""",
    "retokenized": f"""select strategy, count(*) as n, count(*) filter (where tokens = case strategy
          when 'Word' then list_filter(regexp_split_to_array(text, '{SQL_SPACE}'), lambda x: x <> '')
          when 'Bigrams' then list_transform(range(1, length(text)), lambda i: substring(text, i::int, 2))
          else list_transform(range(1, length(text) + 1), lambda i: substring(text, i::int, 1)) end) as same
        from tokenized where tokens is not null group by strategy""",
    "tiered_sample": _TIERED.format(by="") + " select article_id, t as Title, tier, row_number() over (order by tier desc, pos) as ordinal from firsts qualify ordinal <= 10000",
    "tiered_sample_by_source": _TIERED.format(by="source,") + " select source, article_id, tier, row_number() over (partition by source order by tier desc, pos) as ordinal from firsts qualify ordinal <= 50",
    "size_filter": f"with {CLEAN_SQL} select article_id, strlen(x)::bigint as bytes from clean where t <> '' and x <> '' and strlen(x) >= 1024",
    "title_slug": f"select article_id, {_SLUG} as slug, format('article_{{}}_{{}}.txt', article_id, {_SLUG}) as file_name from articles where Title is not null",
    "article_body": f"with {CLEAN_SQL} select article_id, md5('Title: ' || t || chr(10) || x || chr(10)) as body_md5, length('Title: ' || t || chr(10) || x || chr(10))::bigint as n_chars from clean where t <> '' and x <> ''",
    "article_counters": f"with {CLEAN_SQL} select source, count(*) as pages, count(*) filter (where t <> '' and x <> '') as valid, count(distinct case when t <> '' and x <> '' then t end) as titles from clean group by source",
    "experiment_grid": """select * from (values ('Finnish','fi'),('Swahili','sw'),('Hungarian','hu'),('Turkish','tr')) l(lang, code),
        (values ('Word',0,null),('Char',1,null),('Bigrams',2,null),('Trigrams',3,null),('4grams',4,null),('5grams',5,null),
                ('BPE5k',null,5000),('BPE10k',null,10000),('BPE25k',null,25000),('BPE50k',null,50000),('BPE100k',null,100000)) s(strategy, n, vocab)""",
    "word_frequency_by_language": f"""with w as (select lang, unnest(list_filter(regexp_split_to_array(line, '{SQL_SPACE}'), lambda x: x <> '')) as token
          from (select lang, unnest(str_split(Cleaned_Text, chr(10))) as line from articles where lang is not null)),
        c as (select lang, token, count(*) as n from w group by all)
        select lang, token, n, row_number() over (partition by lang order by n desc, token) as place from c qualify place <= 10""",
}
