"""Running counts over article records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.operators.tokenize import line_tokens
from tavuflow.sources.corpus import ARTICLE_SCHEMA


def article_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON line files of a folder as a stream; lines that do not parse are left out."""
    return spark.readStream.schema(ARTICLE_SCHEMA).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)


def running_token_counts(articles: DataFrame, strategy: str = "Word") -> DataFrame:
    """token and n so far. The state holds one row for each distinct token."""
    return line_tokens(articles, "Cleaned_Text", strategy, []).groupBy("token").agg(F.count("*").alias("n"))
