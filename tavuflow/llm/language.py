"""Problem 2: the language of each text and of each line in another language, with a confidence.

Nearest centroids: character n-grams of normalised text, weighted by inverse document frequency, are compared by cosine with
several centroids for each language, found by spherical k-means within the language. A segment far from all centroids is
rejected. The model is fitted on a bounded sample of labelled texts (SAMPLE for each label, chosen by a hash of the key);
since labels may be wrong, texts that lie nearer to another language's centroids are left out and the fit repeated. Every
text is then scored, in whole, sentence by sentence: all on numpy arrays of a block of texts, with one table gather.

Defined results: null, empty and blank texts, and texts without a sentence that can be told, have language null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavuflow.llm.abbrev import INNER, NUMERIC
from tavuflow.llm.codepoints import assigned, blocks, run_hashes, to_codes
from tavuflow.llm.lookalike import normalize_codes
from tavuflow.llm.quality import _tables

#: Labelled texts of each label to fit on, clusters of each language, table size as a power of two, n-gram lengths.
SAMPLE, CLUSTERS, BITS, GRAMS = 300, 3, 16, (3,)
#: A segment is told if it has so many letters.
LEAST_LETTERS = 12
#: Texts that a fit turns into terms at a time.
_FIT_TEXTS = 100
#: A segment is rejected if its cosine is so many deviations below the mean of the language's own segments.
REJECT = 3.5


_STOP, _CLOSE, _QUOTE, _ROMAN, _SPACE, _DIGIT, _UPPER, _LETTER = (1 << i for i in range(8))


@lru_cache(maxsize=1)
def _case() -> tuple[np.ndarray, np.ndarray]:
    """Lower case by one character for one, and the upper-case letters."""
    lower, upper = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for cp in assigned():
        ch = chr(cp)
        low = ch.lower()
        lower[cp] = ord(low[0]) if len(low) <= 2 and low else cp
        upper[cp] = ch != low
    return lower, upper


@lru_cache(maxsize=1)
def _roles() -> np.ndarray:
    """What each character can be around a sentence's end, as bits."""
    t, upper = _tables(), _case()[1]
    out = np.zeros(0x110000, np.uint8)
    for bit, chars in ((_STOP, ".!?…"), (_CLOSE, "\"'”’»)]"), (_QUOTE, "\"'“”„«‘("), (_ROMAN, "IVX")):
        out[[ord(c) for c in chars]] |= bit
    for bit, mask in ((_SPACE, t["space"]), (_DIGIT, t["digit"]), (_UPPER, upper), (_LETTER, t["letter"])):
        out[mask] |= bit
    out[[ord(c) for c in "¿¡"]] |= _QUOTE
    return out


def _hash_names(names: list[str]) -> np.ndarray:
    codes, offsets = to_codes(pa.array(names))
    return np.sort(run_hashes(codes, offsets[:-1], offsets[1:]))


@lru_cache(maxsize=1)
def _short_forms() -> tuple[np.ndarray, np.ndarray]:
    return _hash_names([*INNER, *(x for x in NUMERIC if x not in INNER)]), _hash_names(NUMERIC)


def _holds(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values


class Segments:
    """Sentences of a block of texts, each with its row and line."""

    def __init__(self, column: pa.Array) -> None:
        cased, offsets = normalize_codes(*to_codes(column))
        n = len(cased)
        self.offsets = offsets
        self.codes = _case()[0][cased]
        role = _roles()[cased]
        begin = np.zeros(n + 1, bool)
        begin[offsets[:-1]] = True
        newline = np.flatnonzero(cased == 10)
        begin[newline + 1] = True
        line_start = np.flatnonzero(begin[:n])
        # A mark that ends a sentence, closing marks after it, white space, then something that can begin one.
        at = np.flatnonzero(role & _STOP)
        if len(at):
            is_ = lambda place, bits: (role[np.clip(place, 0, n - 1)] & bits != 0) & (place >= 0) & (place < n)
            nxt = at + 1
            for _ in range(3):
                nxt = nxt + is_(nxt, _CLOSE)
            gap = is_(nxt, _SPACE)
            at, nxt = at[gap], nxt[gap]
            after = nxt + 1
            for _ in range(3):
                after = after + is_(after, _SPACE)
            ok = is_(after, _UPPER | _QUOTE | _DIGIT)
            at, after = at[ok], after[ok]
            # A full stop after a short form, an initial or an ordinal ends nothing.
            dot = cased[at] == 0x2E
            word_edge = np.append(0, np.flatnonzero(role & _SPACE) + 1)
            left = word_edge[np.searchsorted(word_edge, at, side="right") - 1]
            left = np.minimum(left + is_(left, _QUOTE), at)
            width = at - left

            def all_(bits: int, most: int) -> np.ndarray:
                """Whether the token before the stop has at most so many characters, all of this kind."""
                out = (width > 0) & (width <= most)
                for k in range(1, most + 1):
                    out &= (width < k) | is_(at - k, bits)
                return out

            ordinal = all_(_DIGIT, 2) | all_(_ROMAN, 6)
            initial = (width == 1) & is_(left, _UPPER)
            short = np.zeros(len(at), bool)
            held = (width > 0) & (width <= 12)
            if held.any():
                hashes = run_hashes(self.codes, left[held], at[held])
                before_number = _holds(_short_forms()[1], hashes)
                short[held] = _holds(_short_forms()[0], hashes) & (~before_number | is_(after[held], _DIGIT))
            keep = ~(dot & (ordinal | initial | short))
            begin[after[keep]] = True
        begin[n] = False
        self.start = np.flatnonzero(begin[:n]) if n else np.zeros(0, np.int64)
        self.end = np.append(self.start[1:], n) if n else self.start
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        line = np.searchsorted(line_start, self.start, side="right") - 1
        first_line = np.searchsorted(line_start, offsets[self.row])
        self.line = line - first_line
        self.letter = role & _LETTER != 0
        self.letters = np.add.reduceat(self.letter, self.start, dtype=np.int64) if n else self.start

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed n-grams of all segments, those of one segment together, and the segments' offsets in them."""
        codes, letter = self.codes, self.letter
        n = len(codes)
        keep = letter.copy()
        keep[1:] |= letter[:-1] & ~letter[1:]  # one blank after a word
        head = self.start[self.start < n]
        keep[head] = True
        kept = np.flatnonzero(keep)
        text = np.where(letter[kept], codes[kept], np.uint32(32))
        bounds = np.searchsorted(kept, np.append(self.start, n))
        sizes = np.diff(bounds)
        segment = np.repeat(np.arange(len(sizes)), sizes)
        out, parts = [], []
        for k in GRAMS:
            if len(text) < k:
                continue
            h = np.full(len(text) - k + 1, np.uint32(k))
            for j in range(k):
                h = (h ^ text[j : len(text) - k + 1 + j]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            inside = segment[: len(h)] == segment[k - 1 :]
            out.append(((h[inside] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64))
            parts.append(segment[: len(h)][inside])
        if not out:
            return np.zeros(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
        seg, gram = np.concatenate(parts), np.concatenate(out)
        # Sorted by segment and n-gram: repeated n-grams become one term with its count.
        keys = np.sort(seg.astype(np.int64) << BITS | gram)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        self.counts = np.diff(np.append(first, len(keys))).astype(np.float32)
        keys = keys[first]
        return keys & ((1 << BITS) - 1), np.searchsorted(keys >> BITS, np.arange(len(sizes) + 1))


class Model:
    """idf weights, unit centroids and, for each language, the least cosine of its own segments."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray) -> None:
        self.languages, self.idf, self.owner = languages, idf, owner
        self.table = np.ascontiguousarray((centroids * idf[None, :]).T.astype(np.float32))
        self.least = np.zeros(len(languages))

    def cosines(self, segments: Segments) -> np.ndarray:
        """Cosine of each segment with the nearest centroid of each language."""
        grams, offsets = segments.grams()
        k = len(offsets) - 1
        out = np.zeros((k, len(self.languages)), np.float32)
        step = 1 << 15  # terms at a time, so that their rows of the table stay in the cache
        row = 0
        while row < k:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, side="right")) - 1)
            own = slice(offsets[row], offsets[stop])
            counts = segments.counts[own]
            filled = np.flatnonzero(np.diff(offsets[row : stop + 1]) > 0)
            if len(filled):
                begin = offsets[row:stop][filled] - offsets[row]
                dots = np.add.reduceat(self.table[grams[own]] * counts[:, None], begin, axis=0)
                norms = np.sqrt(np.add.reduceat((counts * self.idf[grams[own]]) ** 2, begin))
                dots /= norms[:, None]
                for i in range(len(self.languages)):
                    out[row + filled, i] = dots[:, self.owner == i].max(1)
            row = stop
        return out


def fit(texts: list[str], labels: list[str], clusters: int = CLUSTERS, rounds: int = 8) -> Model:
    """Centroids from labelled texts; in two passes, the second without texts that lie nearer to another language."""
    languages = sorted(set(labels))
    size = 1 << BITS
    if not texts:  # nothing can be told
        return Model([], np.ones(size, np.float32), np.zeros((0, size), np.float32), np.zeros(0, np.int64))
    wanted = np.array([languages.index(x) for x in labels])
    # The texts' terms in one sparse matrix: the n-grams of text i are grams[at[i]:at[i + 1]]. A few texts at a time.
    parts = []
    for first in range(0, len(texts), _FIT_TEXTS):
        segments = Segments(pa.array([t.replace("\n", " ") for t in texts[first : first + _FIT_TEXTS]]))
        gram, ends = segments.grams()
        keys, back = np.unique(np.repeat(segments.row + first, np.diff(ends)) << BITS | gram, return_inverse=True)
        parts.append((keys, np.bincount(back, segments.counts).astype(np.float32)))
    keys, value = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
    grams, owner_text = keys & (size - 1), keys >> BITS
    at = np.searchsorted(owner_text, np.arange(len(texts) + 1))
    idf = (np.log((1 + len(texts)) / (1 + np.bincount(grams, minlength=size))) + 1).astype(np.float32)
    value *= idf[grams]
    norms = np.sqrt(np.bincount(owner_text, value**2, minlength=len(texts)))
    value /= np.maximum(norms[owner_text], 1e-9).astype(np.float32)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)

    def mean(rows: np.ndarray) -> np.ndarray:
        """Unit centroid of some texts."""
        use = np.isin(owner_text, rows)
        return unit(np.bincount(grams[use], value[use], minlength=size).astype(np.float32))

    def dots(rows: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Cosine of each of some texts with each centroid."""
        table = np.ascontiguousarray(middle.T)
        out = np.zeros((len(rows), len(middle)), np.float32)
        for i, r in enumerate(rows):
            own = slice(at[r], at[r + 1])
            out[i] = value[own] @ table[grams[own]]
        return out

    used = np.ones(len(texts), bool)
    everything = np.arange(len(texts))
    for attempt in range(3):
        centroids, owner = [], []
        for i in range(len(languages)):
            own = np.flatnonzero(used & (wanted == i))
            own = own if len(own) else np.flatnonzero(wanted == i)
            k = 1 if attempt == 0 else min(clusters, max(1, len(own) // 8))
            # Start from texts far apart.
            seeds = [mean(own)]
            while len(seeds) < k:
                seeds.append(mean(own[[int(dots(own, np.array(seeds)).max(1).argmin())]]))
            middle = np.array(seeds)
            for _ in range(rounds if k > 1 else 0):
                nearest = dots(own, middle).argmax(1)
                middle = np.array([mean(own[nearest == j]) if (nearest == j).any() else middle[j] for j in range(k)])
            centroids.append(middle)
            owner += [i] * k
        stacked, owner_ = np.concatenate(centroids), np.array(owner)
        used = owner_[dots(everything, stacked).argmax(1)] == wanted
    model = Model(languages, idf, stacked, owner_)
    # How near a language's own sentences lie.
    near: list[list[np.ndarray]] = [[] for _ in languages]
    for first in range(0, len(texts), _FIT_TEXTS):
        segments = Segments(pa.array(texts[first : first + _FIT_TEXTS]))
        cos, owner = model.cosines(segments), segments.row + first
        sure = used[owner] & (segments.letters >= LEAST_LETTERS) & (cos.argmax(1) == wanted[owner])
        for i in range(len(languages)):
            near[i].append(cos[sure & (wanted[owner] == i), i])
    for i, own in enumerate(map(np.concatenate, near)):
        model.least[i] = own.mean() - REJECT * own.std() if len(own) else 0
    return model


def sample_texts(df: DataFrame, key: str, text: str, label: str, size: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most size texts of each label, by a hash of the key: the same ones however the rows are spread."""
    ids = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, label)
    order = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key))
    chosen = F.broadcast(ids.withColumn("_rn", order).filter(F.col("_rn") <= size).select(key, label))  # size x labels rows
    rows = df.drop(label).join(chosen, key).select(F.col(text).alias("t"), F.col(label).alias("l")).orderBy(key).collect()
    return [r["t"] for r in rows], [r["l"] for r in rows]


def tell(model: Model, segments: Segments, n_rows: int) -> dict[str, np.ndarray]:
    """Language and confidence of each segment (-1: none) and of each row."""
    cos = model.cosines(segments)
    k = len(cos)
    if not model.languages:
        none, zero = np.full(k, -1), np.zeros(k)
        return {"language": none, "confidence": zero, "main": np.full(n_rows, -1), "share": np.zeros(n_rows), "second": zero, "top": zero}
    best = cos.argmax(1) if k else np.zeros(0, np.int64)
    top = cos[np.arange(k), best]
    rest = cos.copy()
    rest[np.arange(k), best] = 0
    second = rest.max(1) if k else np.zeros(0)
    told = (segments.letters >= LEAST_LETTERS) & (top >= model.least[best]) & (top > 0)
    language = np.where(told, best, -1)
    confidence = np.where(told, 1 - second / np.maximum(top, 1e-9), 0)
    weight = np.zeros((n_rows, len(model.languages)))
    np.add.at(weight, (segments.row[told], best[told]), segments.letters[told] * confidence[told] ** 0.5)
    main = np.where(weight.max(1, initial=0) > 0, weight.argmax(1) if len(model.languages) else 0, -1)
    share = weight.max(1, initial=0) / np.maximum(weight.sum(1), 1e-9)
    return {"language": language, "confidence": confidence, "main": main, "share": share, "second": second, "top": top}


def identify(df: DataFrame, key: str, text: str, model: Model, least_confidence: float = 0.12, together: int = 2) -> DataFrame:
    """key, language, confidence, and segments: (line_no, language, confidence) of lines with at least ``together`` successive
    sentences in one other language."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # table size x centroids
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, None], object)
        for batch in batches:
            for part in blocks(batch, "text"):
                segments = Segments(part.column("text"))
                found = tell(own, segments, part.num_rows)
                main = found["main"][segments.row] if len(segments.row) else segments.row
                # Sentences that cannot be told neither join nor part a run.
                at = np.flatnonzero((found["language"] >= 0) | (segments.letters >= LEAST_LETTERS))
                row, line, lang = segments.row[at], segments.line[at], found["language"][at]
                foreign = (lang >= 0) & (lang != main[at]) & (found["confidence"][at] >= least_confidence)
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1]) | (lang[1:] != lang[:-1]) | ~foreign[1:] | ~foreign[:-1]
                first = np.flatnonzero(new)
                length = np.diff(np.append(first, len(at)))
                hit = first[foreign[first] & (length >= together)]
                sure = np.add.reduceat(found["confidence"][at], first)[foreign[first] & (length >= together)] / length[foreign[first] & (length >= together)] if len(first) else np.zeros(0)
                entries = pa.StructArray.from_arrays(
                    [pa.array(line[hit].astype(np.int32)), pa.array(names[lang[hit]].tolist(), pa.string()), pa.array(sure.astype(float))],
                    ["line_no", "language", "confidence"],
                )
                offsets = pa.array(np.searchsorted(row[hit], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(names[found["main"]].tolist(), pa.string()), pa.array(found["share"]), pa.ListArray.from_arrays(offsets, entries)],
                    ["key", "language", "confidence", "segments"],
                )

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan, f"key {kind}, language string, confidence double, segments array<struct<line_no:int,language:string,confidence:double>>")
    return out.withColumnRenamed("key", key)
