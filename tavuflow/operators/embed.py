"""Token vectors: training, lookup, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavuflow.config import VECTOR_SIZE
from tavuflow.operators.ranks import ranked
from tavuflow.session import bounded


#: Tokens that one task trains on, about: parts train side by side, and their vectors are added up after each pass.
TOKENS_PER_PART = 2_000_000


def train_word2vec(lines: DataFrame, tokens: str, size: int = VECTOR_SIZE, window: int = 5, min_count: int = 1, seed: int = 42, passes: int = 1, partitions: int | None = None):
    """A skip-gram model of the token lists, trained in parts (by default as many as their number of tokens asks for). The model
    itself, vocabulary times size, is held by each task."""
    from pyspark.ml.feature import Word2Vec

    held = lines.select(tokens).filter(F.size(tokens) > 0)
    if partitions is None:
        partitions = 1 + (held.agg(F.sum(F.size(tokens))).first()[0] or 0) // TOKENS_PER_PART
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, maxIter=passes, numPartitions=partitions, inputCol=tokens, outputCol="vector")
    return model.fit(held)


def save_model(model, path: str) -> None:
    """Replaces what is there."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml.feature import Word2VecModel

    return Word2VecModel.load(path)


def vectors(model) -> DataFrame:
    """token and vector (array<float>) of a trained model."""
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector", "float32").alias("vector"))


def lookup(tokens: DataFrame, token: str, table: DataFrame, size: int = VECTOR_SIZE) -> DataFrame:
    """tokens with vector: that of the token, zeros for an unknown or null one.

    Distinct tokens are few against occurrences, so a table within the bound is broadcast; a larger one is joined by shuffle.
    """
    side = bounded(table.select(F.col("token").alias("_t"), F.col("vector")), rows=50_000)
    return tokens.join(side, F.col(token) == F.col("_t"), "left").drop("_t").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0).cast("float"), size)))


def vocabulary_lines(tokens: DataFrame, token: str) -> DataFrame:
    """id and token, by falling count and then by token: the export form of a vocabulary."""
    counts = tokens.groupBy(token).agg(F.count("*").alias("n"))
    return ranked(counts, [F.desc("n"), F.col(token)], "id", ["n", token]).select("id", token)
