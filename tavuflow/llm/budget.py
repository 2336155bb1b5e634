"""Problem 7: the tokens of each text and of each slice of the corpus under an existing tokenizer.

byte_bpe_50k is a byte-level BPE, not a unigram vocabulary: its counts come from its merges (bytebpe); for vocabularies of
scored pieces ``unigram`` has the trie and the count-only best path. Texts are counted once, next to their labels, and only
numbers are shuffled; slices are summed on the map side, so a source with a third of all rows costs no more.

Defined results: null and empty texts have 0 tokens and count as documents; null labels form a slice of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def budget(counted: DataFrame, key: str, tokens: str, slices: list[str]) -> DataFrame:
    """(level, key, slices..., documents, tokens): one row for each document, each value of each slice column, and each
    combination of them; level names which ('document', a column, or 'all')."""
    rows = counted.select(F.col(key), *slices, F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("_n"))
    sets = [[*slices], *([c] for c in slices)]
    totals = rows.groupingSets(sets, *slices).agg(F.grouping_id().alias("_g"), F.count("*").alias("documents"), F.sum("_n").alias("tokens"))
    width = len(slices)
    names = {0: "all"} | {(2**width - 1) ^ (1 << (width - 1 - i)): c for i, c in enumerate(slices)}
    level = F.coalesce(*[F.when(F.col("_g") == g, F.lit(n)) for g, n in names.items()])
    by_slice = totals.select(level.alias("level"), F.lit(None).cast(counted.schema[key].dataType).alias(key), *slices, "documents", "tokens")
    each = rows.select(F.lit("document").alias("level"), key, *slices, F.lit(1).cast("long").alias("documents"), F.col("_n").alias("tokens"))
    return each.unionByName(by_slice)
