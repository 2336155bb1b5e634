"""Corpus sampling: tiered by size, first come first served, one article for each title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavuflow.functions import text as T
from tavuflow.session import bounded, materialize


def clean_articles(articles: DataFrame, title: str, text: str) -> DataFrame:
    """Titles and texts without white space at their ends, both non-empty (null counts as empty)."""
    return articles.withColumns({title: T.strip(F.col(title)), text: T.strip(F.col(text))}).filter((F.col(title) != "") & (F.col(text) != ""))


def size_tier(text: Column, top_kb: int = 4) -> Column:
    """Whole kilobytes of UTF-8, at most top_kb."""
    return F.least(F.lit(top_kb), F.floor(T.byte_size(text) / 1024)).cast("int")


def tiered_sample(articles: DataFrame, title: str, text: str, order: str, target: int = 10_000, top_kb: int = 4, least_kb: int = 1, group: str | None = None) -> DataFrame:
    """The articles with tier and ordinal: largest tier first, then file order; the first of each title; at most target.

    Only title, tier and place are ranked: the first row of a title is a minimum, taken on the map side too, and the chosen rows
    then join their texts. With group, each group has its own sample of at most target.
    """
    by = [group] if group else []
    tiered = clean_articles(articles, title, text).withColumn("tier", size_tier(F.col(text), top_kb)).filter(F.col("tier") >= least_kb)
    first = tiered.groupBy(*by, F.col(title).alias("_title")).agg(F.min(F.struct((-F.col("tier")).alias("t"), F.col(order).alias("o"))).alias("_m"))
    rank = ["_m", "_title"]
    if group:
        chosen = first.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(*rank))).filter(F.col("ordinal") <= target)
    else:
        top = first.orderBy(*rank).limit(target)  # a sampling operator's limit
        chosen = top.withColumn("ordinal", F.row_number().over(Window.orderBy(*rank)))
    chosen = materialize(chosen.select(*[F.col(c).alias(f"_{c}_") for c in by], "_title", "_m", "ordinal"), "chosen")
    same = (F.col(title) == F.col("_title")) & (F.col("tier") == -F.col("_m.t"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}_"))
    # The place alone picks the rows; only those are cleaned again.
    near = clean_articles(articles.join(bounded(chosen), F.col(order).eqNullSafe(F.col("_m.o"))), title, text).withColumn("tier", size_tier(F.col(text), top_kb))
    return near.filter(same).select(*tiered.columns, "ordinal").dropDuplicates(["ordinal", *by])  # rows of the same title, tier and place
