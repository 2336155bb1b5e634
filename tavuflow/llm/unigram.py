"""Problem 7, for vocabularies of scored pieces: a double-array trie and a best path that only counts.

The trie is two integer arrays: from a state s, character c leads to t = base[s] + c if check[t] = s. The best path over a
segment keeps, for each end, the best score and the number of pieces of the path that reaches it; pieces are not kept. All
distinct segments of a block are walked in step: one numpy operation takes a character of each. A worker keeps the counts of the
segments it has met, so that a segment is walked once.

Defined results: null and empty texts have 0 pieces; a character that no piece covers counts as one piece, or as its UTF-8 bytes
where the vocabulary has pieces for bytes.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavuflow.llm.codepoints import blocks, run_hashes, to_codes, utf8_sizes, whitespace_table, word_runs

#: Segments a worker keeps with their counts; beyond it, it starts anew.
CACHE_SEGMENTS = 1_500_000
#: Characters of the segments walked in step.
STEP_CHARACTERS = 1 << 20
#: Stands before each segment.
MARK = "▁"


class DoubleArrayTrie:
    """Scored pieces; characters that no piece holds have code 0."""

    def __init__(self, scores: dict[str, float], fallback: bool = False) -> None:
        often: dict[str, int] = {}
        for piece in scores:
            for c in piece:
                often[c] = often.get(c, 0) + 1
        letters = sorted(often, key=lambda c: (-often[c], c))  # frequent letters side by side: states then fit into each other
        codes = {c: i + 1 for i, c in enumerate(letters)}
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.fallback = fallback
        self.unknown = min(scores.values(), default=0.0) - 10
        size = 2048 + 2 * len(letters)
        base, check, score = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, np.nan)
        # Breadth first over prefixes; the pieces are sorted, so a prefix is a range.
        words = sorted(([codes[c] for c in p], s) for p, s in scores.items() if p)
        queue = deque([(0, 0, len(words), 0)])
        check[0] = 0
        last, after, hint = 0, list(range(size + 1)), {}  # the next free place, over those that are taken
        after[0] = 1

        def free(place: int) -> int:
            while after[place] != place:
                after[place] = after[after[place]]
                place = after[place]
            return place

        while queue:
            state, low, high, depth = queue.popleft()
            while low < high and len(words[low][0]) == depth:
                score[state] = words[low][1]
                low += 1
            children, i = [], low
            while i < high:
                code, j = words[i][0][depth], i
                while j < high and words[j][0][depth] == code:
                    j += 1
                children.append((code, i, j))
                i = j
            if not children:
                continue
            own = np.array([c for c, _, _ in children])
            if last + len(letters) + 512 >= len(base):  # room for a window beyond the last state
                grow = len(base)
                base, check, score = np.append(base, np.zeros(grow, np.int64)), np.append(check, np.full(grow, -1, np.int64)), np.append(score, np.full(grow, np.nan))
                after.extend(range(len(after), len(base) + 1))
            # A single child takes the first free place; for more, windows of places are tried with all children at once, from
            # where the last state of as many children was put.
            kind = len(own).bit_length()
            at = max(1, hint.get(kind, 0) if len(own) > 1 else 0)
            at = free(at + int(own[0])) - int(own[0])
            while len(own) > 1:
                places = at + np.flatnonzero(check[at + own[0] : at + own[0] + 256] < 0)
                fits = places[(check[places[:, None] + own] < 0).all(1)]
                if len(fits):
                    at = hint[kind] = int(fits[0])
                    break
                at += 256
            base[state] = at
            check[at + own] = state
            last = max(last, at + int(own[-1]))
            for place in (at + own).tolist():
                after[place] = place + 1
            queue.extend((at + code, i, j, depth + 1) for code, i, j in children)
        used = len(check) - int(np.argmax(check[::-1] >= 0))
        self.base, self.check, self.score = (np.append(x[:used], np.full(len(letters) + 1, e, x.dtype)) for x, e in ((base, 0), (check, -1), (score, np.nan)))

    def counts(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces on the best path of each segment codes[start:end], the mark before it. Ties take fewer pieces."""
        out = np.zeros(len(starts), np.int64)
        width = ends - starts + 1
        order = np.argsort(-width, kind="stable")
        at = 0
        while at < len(order):
            stop = at + max(1, STEP_CHARACTERS // int(width[order[at]]))
            own = order[at:stop]
            out[own] = self._walk(codes, starts[own], width[own])
            at = stop
        return out

    def _walk(self, codes: np.ndarray, starts: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Segments in the order of falling width."""
        n, longest = len(starts), int(width[0])
        column = np.arange(1, longest)
        filled = column[None, :] < width[:, None]
        raw = np.zeros((n, longest), np.uint32)
        raw[:, 0] = ord(MARK)
        raw[:, 1:][filled] = codes[(starts[:, None] + column[None, :] - 1)[filled]]
        own = self.code[raw]
        cost = utf8_sizes(raw).astype(np.int32) if self.fallback else np.ones(raw.shape, np.int32)
        best, pieces = np.full((n, longest + 1), -np.inf), np.zeros((n, longest + 1), np.int32)
        best[:, 0] = 0

        def reach(rows: np.ndarray, end: int, score: np.ndarray, made: np.ndarray) -> None:
            old, count = best[rows, end], pieces[rows, end]
            better = (score > old) | ((score == old) & (made < count))
            rows = rows[better]
            best[rows, end], pieces[rows, end] = score[better], made[better]

        for i in range(longest):
            live = int(np.searchsorted(-width, -i, side="left"))  # segments longer than i
            rows = np.arange(live)
            here, made = best[:live, i].copy(), pieces[:live, i].copy()
            reach(rows, i + 1, here + self.unknown, made + cost[:live, i])
            state = np.zeros(live, np.int64)
            for j in range(i, longest):
                inside = width[rows] > j
                rows, state = rows[inside], state[inside]
                code = own[rows, j]
                after = self.base[state] + code
                known = (code > 0) & (self.base[state] > 0) & (self.check[after] == state)
                rows, state = rows[known], after[known]
                if not len(rows):
                    break
                gain = self.score[state]
                whole = ~np.isnan(gain)
                reach(rows[whole], j + 1, here[rows[whole]] + gain[whole], made[rows[whole]] + 1)
        return pieces[np.arange(n), width]


def scored_pieces(path: str) -> tuple[dict[str, float], bool]:
    """(scores, whether there are pieces for bytes) of a sentencepiece model. Pieces of a merge vocabulary have ranks, not chances:
    a piece's score is then the logarithm of its share by Zipf's law, so that one rare piece costs less than two frequent ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in usual}
    ranks = all(s == int(s) for s in scores.values())
    if ranks:
        scores = {p: -math.log(2 - s) for p, s in scores.items()}
    return scores, any(model.is_byte(i) for i in range(model.get_piece_size()))


class Counter:
    """Pieces of the white-space words of texts; keeps the counts of the words it has met."""

    def __init__(self, trie: DoubleArrayTrie) -> None:
        self.trie, self.space = trie, whitespace_table()
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, column: pa.Array) -> np.ndarray:
        codes, offsets = to_codes(column)
        starts, ends, rows = word_runs(codes, offsets, self.space)
        found, first, back = np.unique(run_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_SEGMENTS:
            self._reset()
        at = np.minimum(np.searchsorted(self.hashes, found), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != found if len(self.hashes) else np.ones(len(found), bool)
        if new.any():
            own = first[new]
            merged, counts = np.concatenate([self.hashes, found[new]]), np.concatenate([self.known, self.trie.counts(codes, starts[own], ends[own])])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.known = merged[order], counts[order]
        each = self.known[np.searchsorted(self.hashes, found)][back] if len(found) else np.zeros(0, np.int64)
        return np.bincount(rows, each, minlength=len(offsets) - 1).astype(np.int64)


def counts(df: DataFrame, text: str, trie: DoubleArrayTrie, into: str = "n_tokens") -> DataFrame:
    """df without text and with into: the pieces of a text's white-space words, each with the mark before it."""
    shared = df.sparkSession.sparkContext.broadcast(trie)  # bounded by the vocabulary
    names = [c for c in df.columns if c not in (into, text)]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(into, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter(shared.value)
        for batch in batches:
            for part in blocks(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(own.count(part.column(text)))], [*names, into])

    return df.select(*[F.col(f"`{c}`") for c in [*names, text]]).mapInArrow(run, schema)
