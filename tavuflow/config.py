"""Languages, strategies and thresholds as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The studied languages and their codes.
LANGUAGES = (("Finnish", "fi"), ("Swahili", "sw"), ("Hungarian", "hu"), ("Turkish", "tr"))


@dataclass(frozen=True)
class Strategy:
    """A tokenisation: n is 0 for words, the window for characters and n-grams, null for byte-pair encoding of a vocabulary size."""

    name: str
    n: int | None
    vocab: int | None = None


# The tokenisation strategies.
STRATEGIES = (
    Strategy("Word", 0),
    Strategy("Char", 1),
    Strategy("Bigrams", 2),
    Strategy("Trigrams", 3),
    Strategy("4grams", 4),
    Strategy("5grams", 5),
    *(Strategy(f"BPE{k}k", None, k * 1000) for k in (5, 10, 25, 50, 100)),
)
# The quick subset for trials.
TRIAL_LANGUAGES, TRIAL_STRATEGIES = 3, 5

MIN_SENTENCES = 5  # a language with fewer is skipped
FOLDS = 3
CONTEXT = 5  # neighbours on each side
VECTOR_SIZE = 100


def languages(spark: SparkSession, trial: bool = False) -> DataFrame:
    rows = LANGUAGES[:TRIAL_LANGUAGES] if trial else LANGUAGES
    return spark.createDataFrame([*rows], "lang string, code string")


def strategies(spark: SparkSession, trial: bool = False) -> DataFrame:
    rows = STRATEGIES[:TRIAL_STRATEGIES] if trial else STRATEGIES
    return spark.createDataFrame([(s.name, s.n, s.vocab) for s in rows], "strategy string, n int, vocab int")


def experiments(spark: SparkSession, trial: bool = False) -> DataFrame:
    """Every language with every strategy: both sides are the fixed lists above."""
    return languages(spark, trial).crossJoin(strategies(spark, trial))
