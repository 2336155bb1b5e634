"""Tokenisation strategies as column builders, and what follows from them for labelled words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavuflow.config import STRATEGIES
from tavuflow.functions import text as T

_BY_NAME = {s.name: s for s in STRATEGIES}


def tokenizer(strategy: str) -> Callable[[Column], Column]:
    """The column builder of a strategy. Byte-pair encoding needs a trained model: see tavuflow.operators.bpe."""
    known = _BY_NAME.get(strategy)
    if known is None:
        raise ValueError(f"unknown strategy {strategy}")
    if known.n is None:
        raise ValueError(f"{strategy} needs a model: use bpe.encode")
    return T.words if known.n == 0 else lambda text: T.ngrams(text, known.n)


def lines(articles: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row for each line of a text (line_no from 0), so that no token crosses a line end."""
    return articles.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def line_tokens(articles: DataFrame, text: str, strategy: str, keep: list[str]) -> DataFrame:
    """keep, line_no and token: one row for each token."""
    return lines(articles, text, keep).select(*keep, "line_no", F.explode(tokenizer(strategy)(F.col("line"))).alias("token"))


def token_counts(articles: DataFrame, text: str, strategy: str) -> DataFrame:
    """token and n. Counted on the map side before the shuffle."""
    return line_tokens(articles, text, strategy, []).groupBy("token").agg(F.count("*").alias("n"))


def tokens_of(word: Column, names: list[str]) -> Column:
    """An array of (strategy, token) of a word under several strategies: one scan of the words serves all."""
    parts = [F.transform(tokenizer(s)(word), (lambda s: lambda t: F.struct(F.lit(s).alias("strategy"), t.alias("token")))(s)) for s in names]
    return F.flatten(F.array(*parts))


def propagate(tokens: DataFrame, word: str, strategy: str) -> DataFrame:
    """Each sub-token with its word's other columns (the tag among them) and its place in the word; a word too short for the
    window yields none and so vanishes with its tag."""
    return tokens.select(*tokens.columns, F.posexplode(tokenizer(strategy)(F.col(word))).alias("sub_pos", "token"))


def support(tokens: DataFrame, word: str, group: list[str]) -> DataFrame:
    """group, strategy and support: the number of sub-tokens, from word lengths alone (no sub-token is made)."""
    named = [s for s in STRATEGIES if s.n is not None]
    size = F.char_length(F.col(word))
    sizes = F.array(*[F.struct(F.lit(s.name).alias("strategy"), (F.lit(1) if s.n == 0 else F.greatest(size - (s.n - 1), F.lit(0))).cast("long").alias("k")) for s in named])
    return tokens.select(*group, F.explode(sizes).alias("s")).groupBy(*group, F.col("s.strategy").alias("strategy")).agg(F.sum("s.k").alias("support"))


def vanished(tokens: DataFrame, word: str, group: list[str]) -> DataFrame:
    """group, n and vanished: the words shorter than each window."""
    size = F.char_length(F.col(word))
    counts = [F.count_if(size < n).alias(f"w{n}") for n in range(2, 6)]
    wide = tokens.groupBy(*group).agg(*counts)
    return wide.select(*group, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"w{n}").alias("vanished")) for n in range(2, 6)])).alias("x")).select(*group, "x.n", "x.vanished")
