"""Byte-pair encoding of words by a given table of merges.

Tokenizers are not trained here: merges come from a public vocabulary file or from a table that was saved. Distinct words are
encoded, all words of a batch in step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavuflow.functions.text import words

_NONE = np.int64(1) << 60


def read_vocabulary_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(merges, vocabulary) of a tokenizer file: merges (rank, left, right), vocabulary (id, token). The file is small and fixed."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = pd.DataFrame({"rank": range(len(pairs)), "left": [a for a, _ in pairs], "right": [b for _, b in pairs]})
    vocabulary = pd.DataFrame({"id": list(model["vocab"].values()), "token": list(model["vocab"])})
    return spark.createDataFrame(merges, "rank int, left string, right string"), spark.createDataFrame(vocabulary, "id int, token string")


def save_merges(merges: DataFrame, path: str, mode: str = "error") -> None:
    merges.write.mode(mode).parquet(path)


def load_merges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rank int, left string, right string").parquet(path)


def pair_counts(words_: DataFrame, word: str, n: str) -> DataFrame:
    """left, right and n: how often two characters stand side by side in words that occur n times."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: F.struct(F.substring(F.col(word), i, F.lit(1)).alias("left"), F.substring(F.col(word), i + 1, F.lit(1)).alias("right")))
    return words_.filter(F.char_length(word) > 1).select(F.explode(pairs).alias("p"), n).groupBy("p.left", "p.right").agg(F.sum(n).alias("n"))


class Merger:
    """Merges of many words in step. A symbol is a number; merges are looked up by the numbers of both symbols."""

    def __init__(self, merges: list[tuple[int, str, str]], end: str, prefix: str) -> None:
        self.end, self.prefix = end, prefix
        self.names = sorted({x for _, a, b in merges for x in (a, b, a + b)})
        self.number = {x: i for i, x in enumerate(self.names)}
        self.merged = np.array([self.number[a + b] for _, a, b in sorted(merges)], np.int64)
        pairs = np.array([self.number[a] << 32 | self.number[b] for _, a, b in sorted(merges)], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order

    def number_of(self, name: str) -> int:
        if name not in self.number:  # a character that no merge knows
            self.number[name] = len(self.names)
            self.names.append(name)
        return self.number[name]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(left), _NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)

    def symbols(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first symbols: each character, the first with the prefix and the last with the end."""
        ends = np.cumsum(sizes)
        kind = np.zeros(len(codes), np.int64)
        kind[ends - sizes] += 1
        kind[ends - 1] += 2
        what, back = np.unique(codes.astype(np.int64) << 2 | kind, return_inverse=True)
        name = lambda w: (self.prefix if w & 1 else "") + chr(w >> 2) + (self.end if w & 2 else "")
        return np.array([self.number_of(name(int(w))) for w in what], np.int64)[back]

    def merge(self, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and their rows: in each step each row merges its pair of least rank at all places, from the
        left. Rows without a pair to merge are set aside."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            pair = np.full(len(ids), _NONE)
            inner = np.flatnonzero(row[1:] == row[:-1])
            pair[inner] = self.rank(ids[inner], ids[inner + 1])
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            size = np.diff(np.append(begin, len(ids)))
            least = np.repeat(np.minimum.reduceat(pair, begin), size)
            live = least < _NONE
            done.append((ids[~live], row[~live]))
            ids, row, pair, least = ids[live], row[live], pair[live], least[live]
            if not len(ids):
                break
            hit = pair == least
            # Of places side by side (the same symbol again and again) every second one is taken.
            place = np.arange(len(ids))
            first = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, -1))
            hit &= (place - first) % 2 == 0
            at = np.flatnonzero(hit)
            ids[at] = self.merged[least[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, row = ids[keep], row[keep]
        ids, row = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(row, kind="stable")
        return ids[order], row[order]

    def encode(self, words_: pa.Array) -> pa.Array:
        """The sub-words of each word, as lists."""
        words_ = words_.cast(pa.large_string())
        sizes = pc.utf8_length(words_).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.frombuffer("".join(words_.to_pylist()).encode("utf-32-le"), np.uint32)
        filled = np.flatnonzero(sizes)
        ids, row = self.merge(self.symbols(codes, sizes[filled]), np.repeat(filled, sizes[filled]))
        offsets = np.searchsorted(row, np.arange(len(words_) + 1)).astype(np.int32)
        known, back = np.unique(ids, return_inverse=True)
        names = pa.array([self.names[i] for i in known], pa.string())
        return pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(back)))


def merger(spark: SparkSession, merges: DataFrame, end: str = "</w>", prefix: str = ""):
    """A broadcast of the merges' tables, bounded by the vocabulary's size."""
    rows = [(r["rank"], r["left"], r["right"]) for r in merges.collect()]
    return spark.sparkContext.broadcast(Merger(rows, end, prefix))


def encode_words(words_: DataFrame, word: str, shared, into: str = "tokens") -> DataFrame:
    """words_ with into: the sub-words of each word; meant for distinct words. Null words give null."""
    names = [c for c in words_.columns if c != into]
    schema = T.StructType([*(words_.schema[c] for c in names), T.StructField(into, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(word)
            made = shared.value.encode(pc.fill_null(column, ""))
            out = pc.if_else(pc.is_valid(column), made, pa.nulls(len(made), made.type))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), out], [*names, into])

    return words_.select(*names).mapInArrow(run, schema)


def encoder(spark: SparkSession, merges: DataFrame, end: str = "</w>", prefix: str = "", lower: bool = False):
    """A column builder: text to the sub-words of its words. prefix stands before a word's first symbol, end after its last. Each
    distinct word of a batch is encoded once."""
    shared = merger(spark, merges, end, prefix)

    @F.arrow_udf("array<string>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = batch.flatten().dictionary_encode()
            made = shared.value.encode(flat.dictionary).take(flat.indices)
            per = np.append(0, np.cumsum(made.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))
            ends = np.append(0, np.cumsum(pc.fill_null(batch.value_lengths(), 0).to_numpy(zero_copy_only=False)))
            mask = pc.is_null(batch)
            yield pa.ListArray.from_arrays(pa.array(per[ends].astype(np.int32)), made.flatten(), mask=mask)

    def build(text: Column) -> Column:
        return encode(words(F.lower(text) if lower else text))

    return build
