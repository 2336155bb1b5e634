"""Article records and line corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.functions import text as T
from tavuflow.session import hadoop_exists

ARTICLE_SCHEMA = "Title string, Cleaned_Text string"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there; a missing one is no error."""
    return [p for p in paths if hadoop_exists(spark, p)]


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article records from JSON lines; lines that do not parse are left out."""
    return spark.read.schema(ARTICLE_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def numbered(articles: DataFrame, order: str = "pos") -> DataFrame:
    """articles with their place in the files (file, then place in it): splits of one file come in order."""
    with_place = articles.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    return with_place.withColumn(order, F.struct("_file", "_block", "_id")).drop("_file", "_block", "_id")


def write_articles(articles: DataFrame, path: str, mode: str = "error") -> None:
    articles.write.mode(mode).json(path)


def write_sample(sample: DataFrame, path: str, by: str = "source", title: str = "Title", text: str = "Cleaned_Text", mode: str = "error") -> None:
    """The sampled articles as a table by source (or language): ordinal, file name and body, not one file for each."""
    rows = sample.select(by, "ordinal", T.article_name(F.col("ordinal"), F.col(title)).alias("file_name"), T.article_body(F.col(title), F.col(text)).alias("body"))
    rows.write.mode(mode).partitionBy(by).parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line of article files; path may be a glob or a folder of article_*.txt."""
    reader = spark.read
    return (reader if any(c in path for c in "*?") else reader.option("pathGlobFilter", "article_*.txt")).text(path).select(F.col("value").alias("text"))


def sample_lines(sample: DataFrame, by: list[str]) -> DataFrame:
    """Lines of a written sample's bodies."""
    return sample.select(*by, "ordinal", "file_name", F.posexplode(F.split("body", "\n")).alias("line_no", "text"))


def write_tokenized(tokens: DataFrame, path: str, mode: str = "error") -> None:
    """Tokenised lines (lang, strategy, text, tokens) by language and strategy, so that reading one prunes the rest."""
    tokens.write.mode(mode).partitionBy("lang", "strategy").parquet(path)


def write_vocabulary(vocabulary: DataFrame, path: str, mode: str = "error") -> None:
    """id<TAB>token lines."""
    vocabulary.orderBy("id").select(F.concat_ws("\t", F.col("id").cast("string"), "token").alias("value")).write.mode(mode).text(path)
