"""Problem 6: near-duplicate records by order min hash, verified by banded alignment and an exact check.

Each text is brought to its consistent form, lower-cased and cut at white space; its k-mers are runs of k words. A sketch takes
the few k-mers with the least hash. ORDERED of the sketches are order min hashes: their k-mers are labelled by occurrence and
kept in the order in which they stand in the text, so the chance to agree follows the edit similarity. FREE of them hold distinct
k-mers whatever their order and number, so that texts with parts reordered or repeated meet as often as others of their Jaccard
similarity. Records that share any sketch are candidates.

A candidate is dropped unread only where a bound proves its Jaccard similarity to be below the threshold: the k-mers in both are
at most the common bits of two bit sets, and those that share a bit with another. The rest is verified on word sequences: a
banded alignment gives the edits, and few edits prove the similarity, as one edit changes at most k k-mers; the exact similarity
of the k-mer sets decides what the alignment leaves open. With verify="alignment" the edit similarity itself decides.

Exact copies are one class from the start, so that a group of copies costs one record; sketches of a crowd of near copies
join through AQE's skew splitting and no group is ever collected. Nothing is capped: every candidate is verified.

Defined results: null texts and texts of fewer than min_words words are left out; a repeated key with another text is another
record; no candidate gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavuflow.llm.codepoints import assigned, blocks, mix, run_hashes, to_codes, whitespace_table, word_runs
from tavuflow.llm.lookalike import normalize_codes
from tavuflow.session import bounded, materialize

#: Words of a k-mer; order min hashes and order-free sketches of a text; k-mers of a sketch.
K_WORDS, ORDERED, FREE, PER_SKETCH = 3, 24, 40, 2
#: Bits of a text's k-mer set.
SET_BITS = 1024
#: Cells of the alignment table of all pairs aligned in step; a pair whose own band holds more is left to the exact check.
CELLS = 20_000_000
#: Texts of at most so many distinct k-mers also meet by each single one.
_FEW = 8
_INDEX_BITS = 22  # k-mers of one text that a sketch tells apart by place; more for a longer text
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
#: k-mers worked on at a time, so that the arrays stay in the processor's cache.
_CHUNK = 40_000


@lru_cache(maxsize=1)
def _lower() -> tuple[np.ndarray, dict[int, list[int]]]:
    one, many = np.arange(0x110000, dtype=np.uint32), {}
    for cp in assigned():
        low = chr(cp).lower()
        if len(low) == 1:
            one[cp] = ord(low)
        else:
            many[cp] = [ord(c) for c in low]
    return one, many


def lower_codes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case by table; a letter whose lower case is two characters is expanded."""
    one, many = _lower()
    out = one[codes]
    for cp, to in many.items():
        at = np.flatnonzero(codes == cp)
        if len(at):
            size = np.ones(len(out), np.int64)
            size[at] = len(to)
            ends = np.append(0, np.cumsum(size))
            wide = np.repeat(out, size)
            for i, c in enumerate(to):
                wide[ends[at] + i] = c
            codes = np.repeat(codes, size)
            out, offsets = wide, ends[offsets]
    return out, offsets


def kmers(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and the rows' offsets in them, k-mer hashes and the rows' offsets in those."""
    codes, offsets = lower_codes(*normalize_codes(*to_codes(column)))
    starts, ends, rows = word_runs(codes, offsets, whitespace_table_cached())
    words = run_hashes(codes, starts, ends)
    word_offsets = np.searchsorted(rows, np.arange(len(offsets)))
    return words, word_offsets, *runs(words, word_offsets, k)


def runs(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of k words of a row, and the rows' offsets in them."""
    sizes = np.maximum(np.diff(offsets) - k + 1, 0)
    at = np.append(0, np.cumsum(sizes))
    first = np.repeat(offsets[:-1] - at[:-1], sizes) + np.arange(at[-1])
    out = np.full(len(first), np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[first + i])
    return out, at


@lru_cache(maxsize=1)
def whitespace_table_cached() -> np.ndarray:
    return whitespace_table()


def label_occurrences(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each value mixed with the number of its occurrence in its row."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, rows))
    sorted_, row = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]) | (row[1:] != row[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    nth = np.arange(len(values)) - start
    out = values.copy()
    again = nth > 0
    out[order[again]] = mix(values[order[again]] + nth[again].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's different values in rising order, and the rows' offsets in them."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.append(0, np.cumsum(np.bincount(rows[new], minlength=len(offsets) - 1)))


def sketches(values: np.ndarray, offsets: np.ndarray, count: int, per: int = PER_SKETCH, ordered: bool = True) -> np.ndarray:
    """count min-hash keys for each row (rows without values must not be given): of labelled values in the order of the text, or
    of values that are each row's distinct ones in rising order.

    Unordered, the first keys of a row of few distinct values are these values: two of them need not share as many as per.
    """
    labelled = label_occurrences(values, offsets) if ordered else values
    n_rows = len(offsets) - 1
    out = np.empty((n_rows, count), np.uint64)
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB if ordered else 0xA0761D6478BD642F))
    row = 0
    while row < n_rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _CHUNK, side="right")) - 1)
        part = labelled[offsets[row] : offsets[stop]]
        begin = offsets[row:stop] - offsets[row]
        place = np.arange(len(part), dtype=np.uint64) - np.repeat(begin, np.diff(offsets[row : stop + 1])).astype(np.uint64)
        low = np.uint64((1 << max(_INDEX_BITS, len(part).bit_length())) - 1)
        for j in range(count):
            h = part ^ seeds[j]
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9FB21C651E98DF25)
            h &= ~low
            h |= place
            picks = []
            for _ in range(per):
                least = np.minimum.reduceat(h, begin)
                at = begin + (least & low).astype(np.int64)
                at = np.where(least == _MAX, -1, at)  # fewer k-mers than asked for
                picks.append(at)
                h[at[at >= 0]] = _MAX
            order = np.sort(np.stack(picks), axis=0)
            key = np.full(stop - row, seeds[j])
            for at in order:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(at >= 0, part[np.maximum(at, 0)], np.uint64(0)))
            out[row:stop, j] = key
        row = stop
    if not ordered:
        size = np.diff(offsets)
        for j in range(min(_FEW, count)):
            own = np.flatnonzero((size > j) & (size <= min(_FEW, count)))
            out[own, j] = mix(values[offsets[own] + j] + np.uint64(0xE7037ED1A0B428DB))
    return out


def bit_sets(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SET_BITS bits of each row's values, as rows of 64-bit numbers."""
    out = np.zeros((len(offsets) - 1, SET_BITS), bool)
    out[np.repeat(np.arange(len(out)), np.diff(offsets)), (values & np.uint64(SET_BITS - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def fingerprints(words: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row's word sequence (rows without words must not be given)."""
    place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    salted = mix(words + (place.astype(np.uint64) + np.uint64(2 * seed + 1)) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(salted, offsets[:-1]) + np.diff(offsets).astype(np.uint64))


def banded_distances(a: list[np.ndarray], b: list[np.ndarray], share: float) -> np.ndarray:
    """Edit distances of pairs of word sequences, all pairs in step; exact up to share of the longer one's length, more beyond.

    Only a band around the diagonal is filled: no alignment with so few edits leaves it.
    """
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    longest = np.maximum(la, lb)
    band = int(np.ceil(share * longest.max())) + 1 if len(a) else 1
    rows, width = int(la.max(initial=0)), 2 * band + 1
    big = np.int32(1 << 29)
    left = np.zeros((len(a), rows + 1), np.uint64)
    right = np.zeros((len(b), rows + 2 * band + 2), np.uint64)  # column j stands at j + band
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, 1 : len(x) + 1] = x
        y = y[: rows + band + 1]
        right[i, band + 1 : band + 1 + len(y)] = y
    step = np.arange(width, dtype=np.int32)
    column = step[None, :] - band
    now = np.where((column >= 0) & (column <= lb[:, None]), column, big).astype(np.int32)
    out = np.full(len(a), big, np.int32)

    def note(i: int) -> None:
        at = lb - i + band
        hit = (la == i) & (at >= 0) & (at < width)
        out[hit] = now[hit, at[hit]]

    note(0)
    for i in range(1, rows + 1):
        column = i - band + step
        valid = (column[None, :] >= 0) & (column[None, :] <= lb[:, None])
        differ = (right[:, i : i + width] != left[:, i : i + 1]).astype(np.int32)
        new = now + differ
        new[:, :-1] = np.minimum(new[:, :-1], now[:, 1:] + 1)
        new[:, column == 0] = i
        new = np.where(valid, new, big)
        now = (np.minimum.accumulate(new - step[None, :], axis=1) + step[None, :]).astype(np.int32)
        now = np.where(valid, np.minimum(now, big), big)
        note(i)
    return np.minimum(out, longest)


def common_values(a: np.ndarray, a_offsets: np.ndarray, b: np.ndarray, b_offsets: np.ndarray) -> np.ndarray:
    """How many values each row of a shares with the same row of b; the values of a row differ."""
    rows = np.arange(len(a_offsets) - 1)
    row = np.concatenate([np.repeat(rows, np.diff(a_offsets)), np.repeat(rows, np.diff(b_offsets))])
    values = np.concatenate([a, b])
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    twice = (values[1:] == values[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][twice], minlength=len(rows))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows of a list array, and the rows' offsets in them."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.append(0, np.cumsum(sizes, dtype=np.int64))


def aligned(a: np.ndarray, a_offsets: np.ndarray, b: np.ndarray, b_offsets: np.ndarray, share: float) -> np.ndarray:
    """Edits between the word sequences of each row of a and of b: exact up to share of the longer one's words, -1 beyond and
    where a pair's band holds more than CELLS cells. Pairs of like lengths are aligned in step."""
    la, lb = np.diff(a_offsets), np.diff(b_offsets)
    longest = np.maximum(la, lb)
    most = np.floor(share * longest).astype(np.int64)
    cells = (longest + 1) * (2 * most + 3)
    out = np.full(len(la), -1, np.int64)
    order = np.argsort(longest, kind="stable")
    order = order[(abs(la - lb) <= most)[order] & (cells <= CELLS)[order]]
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and cells[order[stop]] * (stop + 1 - at) <= CELLS:
            stop += 1
        own = order[at:stop]
        left, right = [a[a_offsets[i] : a_offsets[i + 1]] for i in own], [b[b_offsets[i] : b_offsets[i + 1]] for i in own]
        edits = banded_distances(left, right, share)
        out[own] = np.where(edits <= most[own], edits, -1)
        at = stop
    return out


def _scan(df: DataFrame, key: str, text: str, k: int, min_words: int, fields: str, made) -> DataFrame:
    """(id, fp, fp2) and fields of the rows of enough words; made gives their arrays from words, k-mers and the offsets of both."""
    kind = df.schema[key].dataType.simpleString()
    names = ["id", "fp", "fp2", *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                words, word_offsets, values, offsets = kmers(part.column("text"), k)
                enough = np.diff(word_offsets) >= max(min_words, k)
                if not enough.any():
                    continue
                held_words = words[np.repeat(enough, np.diff(word_offsets))]
                word_offsets = np.append(0, np.cumsum(np.diff(word_offsets)[enough]))
                held = values[np.repeat(enough, np.diff(offsets))]
                offsets = np.append(0, np.cumsum(np.diff(offsets)[enough]))
                ids = part.column("id").filter(pa.array(enough))
                fps = [pa.array(fingerprints(held_words, word_offsets, s).view(np.int64)) for s in (1, 2)]
                yield pa.RecordBatch.from_arrays([ids, *fps, *made(held_words, word_offsets, held, offsets)], names)

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(run, f"id {kind}, fp bigint, fp2 bigint, {fields}")


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))


def near_duplicates(
    df: DataFrame,
    key: str,
    text: str,
    k: int = K_WORDS,
    min_words: int = 20,
    threshold: float = 0.5,
    ordered: int = ORDERED,
    free: int = FREE,
    per: int = PER_SKETCH,
    verify: str = "jaccard",
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, fp, fp2, n_words) has the class of each record, classes being texts of the same words;
    links (fp_a, fp2_a, fp_b, fp2_b, similarity, edits) the pairs of classes at or above threshold, each once, where edits is
    null if they are more than the band holds.

    Pairs that share any sketch are candidates. At a Jaccard similarity of 0.5, whatever the order, each of 40 sketches of two
    k-mers agrees with a chance of nearly a quarter: none agrees in about 1 of 100,000 pairs; where the order is kept, the 24
    order min hashes bring that to about 1 of 100 million.
    """
    if verify not in ("jaccard", "alignment"):
        raise ValueError("verify is jaccard or alignment")

    def sketched(words, word_offsets, values, offsets):
        own, at = distinct(values, offsets)
        keys = np.concatenate([sketches(values, offsets, ordered, per), sketches(own, at, free, per, ordered=False)], axis=1)
        bits = bit_sets(own, at)
        lists = [_lists(x.ravel(), np.arange(0, x.size + 1, x.shape[1])) for x in (keys, bits)]
        return [pa.array(np.diff(word_offsets)), pa.array(np.diff(at)), lists[1], lists[0]]

    scanned = materialize(_scan(df, key, text, k, min_words, "n_words bigint, n bigint, bits array<bigint>, sketch array<bigint>", sketched), "sketches")
    members = scanned.select("id", "fp", "fp2", "n_words")
    heads = materialize(members.groupBy("fp", "fp2").agg(F.min("id").alias("id")), "heads")
    own = bounded(heads.select("id", "fp"))
    rows = scanned.select("id", "fp", "sketch").join(own, ["id", "fp"], "left_semi").select("fp", F.explode("sketch").alias("key"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))).select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b"))
    pairs = met.distinct()
    sets = scanned.select("id", "fp", "fp2", "n", "bits").join(own, ["id", "fp"], "left_semi").drop("id")
    for side in "ab":
        pairs = pairs.join(sets.toDF(*(f"{c}_{side}" for c in sets.columns)), f"fp_{side}")
    if verify == "jaccard":
        most = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
        spare = lambda s: F.col(f"n_{s}") - F.aggregate(f"bits_{s}", F.lit(0), lambda t, x: t + F.bit_count(x))
        pairs = pairs.filter((most + F.least(spare("a"), spare("b"))) * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-6)
    pairs = materialize(pairs.select("fp_a", "fp2_a", "fp_b", "fp2_b").distinct(), "candidates")
    ends = materialize(pairs.select(F.col("fp_a").alias("fp")).union(pairs.select("fp_b")).distinct(), "ends")
    wanted = materialize(heads.join(bounded(ends), "fp", "left_semi").select(F.col("id").alias(key)).distinct(), "wanted")
    texts = df.join(bounded(wanted), key, "left_semi")
    words = _scan(texts, key, text, k, min_words, "words array<bigint>", lambda words, at, *_: [_lists(words, at)])
    words = words.select("fp", "fp2", "words").repartition("fp", "fp2").dropDuplicates(["fp", "fp2"])
    for side in "ab":
        pairs = pairs.join(words.toDF(*(f"{c}_{side}" for c in words.columns)), [f"fp_{side}", f"fp2_{side}"])
    # One edit changes at most k k-mers: with more edits than this no alignment proves a similarity of threshold.
    band = 1 - threshold if verify == "alignment" else (1 - threshold) / (1 + threshold) / k
    names = ["fp_a", "fp2_a", "fp_b", "fp2_b"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at_x), (y, at_y) = (_flat(batch.column(f"words_{s}")) for s in "ab")
            edits = aligned(x, at_x, y, at_y, band)
            if verify == "alignment":
                similarity = 1 - edits / np.maximum(np.diff(at_x), np.diff(at_y))
                keep = (edits >= 0) & (similarity >= threshold)
            else:
                (x, at_x), (y, at_y) = (distinct(*runs(v, at, k)) for v, at in ((x, at_x), (y, at_y)))
                n_x, n_y = np.diff(at_x), np.diff(at_y)
                both = common_values(x, at_x, y, at_y)
                similarity = both / (n_x + n_y - both)
                proven = (edits >= 0) & (similarity_at_least(n_x, n_y, k * edits) >= threshold)
                keep = proven | (similarity >= threshold)
            told = [pa.array(similarity), pa.array(edits, mask=edits < 0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *told], [*names, "similarity", "edits"]).filter(pa.array(keep))

    links = pairs.mapInArrow(check, ", ".join(f"{c} bigint" for c in names) + ", similarity double, edits bigint")
    return members, links


def similarity_at_least(n_a: np.ndarray, n_b: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """The least Jaccard similarity of sets of these sizes if at most so many members of either are not in the other."""
    both = np.maximum(np.maximum(n_a, n_b) - lost, 0)
    return both / (n_a + n_b - both)


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), the smaller first: the pairs of records of linked classes and of the same class."""
    a = members.select(F.col("fp").alias("fp_a"), F.col("fp2").alias("fp2_a"), F.col("id").alias("x"))
    b = members.select(F.col("fp").alias("fp_b"), F.col("fp2").alias("fp2_b"), F.col("id").alias("y"))
    near = links.select("fp_a", "fp2_a", "fp_b", "fp2_b").join(a, ["fp_a", "fp2_a"]).join(b, ["fp_b", "fp2_b"]).select("x", "y")
    same = a.join(b, (F.col("fp_a") == F.col("fp_b")) & (F.col("fp2_a") == F.col("fp2_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return near.union(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter("id_a <> id_b").distinct()


def groups(members: DataFrame, links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, group_id): the connected groups of records, named by their least class; a record without links is its own class's.

    Alternating large-star and small-star rounds on the links between classes: each round only takes minima of neighbours by
    aggregation, writes its edges to the shared folder, and the number of rounds grows with the logarithm of a group's size. It
    is an error if the edges still change after so many rounds.
    """
    name = lambda s: F.struct(F.col(f"fp_{s}").alias("f"), F.col(f"fp2_{s}").alias("g"))
    edges = materialize(links.select(F.greatest(name("a"), name("b")).alias("u"), F.least(name("a"), name("b")).alias("v")).distinct(), "edges")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Large star joins each greater neighbour to the least; small star each lesser neighbour and the node itself."""
        both = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    for _ in range(rounds):
        before, edges = edges, materialize(star(star(edges, True), False), "edges")
        if edges.count() == before.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"the groups still change after {rounds} rounds")
    own = F.struct(F.col("fp").alias("f"), F.col("fp2").alias("g"))
    at = edges.select(F.col("u").alias("c"), F.col("v").alias("r"))
    named = members.withColumn("c", own).join(at, "c", "left").withColumn("r", F.coalesce("r", "c"))
    return named.select("id", F.hex(F.col("r.f")).alias("group_a"), F.hex(F.col("r.g")).alias("group_b")).select("id", F.concat("group_a", F.lit("-"), "group_b").alias("group_id"))
