"""Problems 7 and 8: token ids and token counts under a public byte-level BPE vocabulary.

A text is cut into pieces (contractions, letters, numbers, other marks, white space) on numpy code-point arrays; each piece
a worker has not met before is encoded once, many pieces in step, with a segment tree over its adjacent pair ranks: the root
holds the leftmost lowest-rank merge, each merge updates its neighbours' leaves and their paths, until no pair can be merged.

Defined results: null and empty texts give the empty list; names of special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavuflow.llm.codepoints import assigned, blocks, mix, run_hashes, to_codes, utf8_sizes, whitespace_table

DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_NAME = "byte_bpe_50k"
#: Pieces a worker keeps (8 bytes of hash and a few ids each); beyond it, it starts anew.
CACHE_PIECES = 1_500_000
#: Leaves of the tree of a long piece.
LONG_LEAVES = 1024
_NONE = np.int64(1) << 62
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_PLACE_BITS = 32


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, extra = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            names[chr(256 + extra)] = b
            extra += 1
    return names


class Vocabulary:
    """Merges as an open-addressed table from (left id, right id) to rank and merged id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            content = f.read()
        self.digest = hashlib.md5(content).hexdigest()
        model = json.loads(content)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int32)
        for name, byte in _byte_names().items():
            self.byte_ids[byte] = vocab[name]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = (left << np.uint64(32)) | right
        self.bits = np.uint64(64 - max(4, (len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.zeros(size, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), (mix(keys) >> self.bits).tolist(), strict=True)):
            while self.keys[slot] != 0xFFFFFFFFFFFFFFFF:
                slot = (slot + 1) % size
            self.keys[slot], self.ranks[slot] = key, rank
        self.mask = size - 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, _NONE where they do not merge."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = (mix(key) >> self.bits).astype(np.int64)
        out = np.full(len(key), _NONE)
        open_ = np.arange(len(key))
        while len(open_):
            held = self.keys[slot]
            hit = held == key
            out[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))
            open_, key, slot = open_[on], key[on], (slot[on] + 1) & self.mask
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for cp in assigned():
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = _LETTER
        elif kind == "N":
            out[cp] = _NUMBER
    out[whitespace_table()] = _SPACE
    return out


def piece_starts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a piece starts, by the vocabulary's pattern: 's 't 're 've 'm 'll 'd; letters, numbers or others, each with
    one space before them; white space up to the last one before something else."""
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[codes]
    head = np.zeros(n, bool)
    head[offsets[:-1][offsets[:-1] < n]] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= head
    # The next place holds something else of the same row.
    follows = np.zeros(n, bool)
    follows[:-1] = (kind[1:] != _SPACE) & ~head[1:]
    solid = kind != _SPACE
    last_space = ~solid & follows
    start = change.copy()
    start |= last_space
    # A single blank goes with what follows it.
    joined = np.zeros(n, bool)
    joined[1:] = last_space[:-1] & (codes[:-1] == 0x20)
    start[joined] = False
    # Contractions: an apostrophe that begins a piece.
    quote = np.flatnonzero((codes == 0x27) & start)
    if len(quote):
        row_end = offsets[np.searchsorted(offsets, quote, side="right")]
        at = lambda k: np.where(quote + k < row_end, codes[np.minimum(quote + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        length = np.where(short, 2, np.where(pair, 3, 0))
        hit = length > 0
        quote, length, row_end = quote[hit], length[hit], row_end[hit]
        start[quote + 1] = False
        end = quote + length
        inside = end < row_end
        after = end[inside]
        # What follows starts anew, unless it is a blank that keeps its own rule (then it starts anyway).
        start[after] = True
    return start


class Encoder:
    """Encodes blocks of texts; keeps the ids of pieces it has met."""

    def __init__(self, vocab: Vocabulary | str) -> None:
        self.vocab = vocabulary(vocab) if isinstance(vocab, str) else vocab
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.spot = np.zeros(0, np.int64)  # place in starts of each hash
        self.first = np.zeros(1, np.int64)  # ids of piece i: ids[first[i]:first[i + 1]]
        self.ids = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        sizes, ids = encode_pieces(self.vocab, codes, starts, ends)
        place = len(self.first) - 1 + np.arange(len(hashes))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        merged = np.concatenate([self.hashes, hashes])
        order = np.argsort(merged, kind="stable")
        self.hashes, self.spot = merged[order], np.concatenate([self.spot, place])[order]

    def pieces(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cached place of each piece, and the row offsets in pieces."""
        begin = piece_starts(codes, offsets)
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(codes))
        row_offsets = np.searchsorted(starts, offsets)
        hashes = run_hashes(codes, starts, ends)
        known, at_first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_PIECES:
            self._reset()
        spot = np.searchsorted(self.hashes, known)
        new = np.ones(len(known), bool)
        inside = spot < len(self.hashes)
        new[inside] = self.hashes[spot[inside]] != known[inside]
        if new.any():
            at = at_first[new]
            self._learn(known[new], codes, starts[at], ends[at])
        return self.spot[np.searchsorted(self.hashes, known)][back], row_offsets

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and the offsets of each row in them."""
        codes, offsets = to_codes(column)
        place, row_offsets = self.pieces(codes, offsets)
        size = self.first[place + 1] - self.first[place]
        ends = np.zeros(len(place) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        take = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.first[place], size)
        return self.ids[take], ends[row_offsets]

    def count(self, column: pa.Array) -> np.ndarray:
        codes, offsets = to_codes(column)
        place, row_offsets = self.pieces(codes, offsets)
        ends = np.zeros(len(place) + 1, np.int64)
        np.cumsum(self.first[place + 1] - self.first[place], out=ends[1:])
        return np.diff(ends[row_offsets])


def encode_pieces(vocab: Vocabulary, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each piece codes[start:end], and all ids in order."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    lengths = ends - starts
    take = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)
    held = codes[take]
    data = np.frombuffer(held.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    byte_ends = np.cumsum(utf8_sizes(held), dtype=np.int64)
    last = byte_ends[np.cumsum(lengths) - 1]
    first = np.append(0, last[:-1])
    width = last - first
    sizes = np.zeros(len(starts), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    level = np.ceil(np.log2(np.maximum(width - 1, 1))).astype(np.int64)
    for power in np.unique(level):
        group = np.flatnonzero(level == power)
        if 1 << int(power) >= LONG_LEAVES:  # long pieces are few: each by itself, all places of a pair at a time
            for row in group:
                ids = _merge_long(vocab, data[first[row] : first[row] + width[row]], 1 << int(power))
                sizes[row] = len(ids)
                parts.append((np.array([row]), np.array([len(ids)]), ids))
            continue
        chunk = max(1, (1 << 20) >> int(power))
        for at in range(0, len(group), chunk):
            rows = group[at : at + chunk]
            n, ids = _merge(vocab, data, first[rows], width[rows], 1 << int(power))
            sizes[rows] = n
            parts.append((rows, n, ids))
    out = np.zeros(sizes.sum(), np.int32)
    begin = np.cumsum(sizes) - sizes
    for rows, n, ids in parts:
        out[np.repeat(begin[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = ids
    return sizes, out


def _merge(vocab: Vocabulary, data: np.ndarray, first: np.ndarray, width: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge pieces of at most leaves + 1 bytes in step. Row i of the trees belongs to piece i."""
    count = len(first)
    slots = leaves + 1
    column = np.arange(slots)
    filled = column[None, :] < width[:, None]
    ids = np.full((count, slots), -1, np.int32)
    ids[filled] = vocab.byte_ids[data[(first[:, None] + column[None, :])[filled]]]
    # right / left: the next and the last living symbol; slots stands for none.
    right = np.where(column[None, :] + 1 < width[:, None], column[None, :] + 1, slots).astype(np.int32)
    left = np.broadcast_to(column[None, :] - 1, (count, slots)).astype(np.int32)
    # tree[:, 1] is the root, tree[:, leaves + p] the pair that starts at p: rank above place, so ties go to the left.
    tree = np.full((count, 2 * leaves), _NONE)
    both = filled[:, 1:]
    pair = vocab.rank(ids[:, :-1][both], ids[:, 1:][both])
    place = np.broadcast_to(column[None, :-1], both.shape)[both]
    tree[:, leaves:][both] = np.where(pair == _NONE, _NONE, (pair << _PLACE_BITS) | place)
    for node in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    root = 1 if leaves > 1 else leaves
    rows = np.flatnonzero(tree[:, root] < _NONE)
    while len(rows):
        best = tree[rows, root]
        at = (best & ((1 << _PLACE_BITS) - 1)).astype(np.int64)
        gone = right[rows, at].astype(np.int64)
        ids[rows, at] = vocab.merged[best >> _PLACE_BITS]
        ids[rows, gone] = -1
        after = right[rows, gone].astype(np.int64)
        before = left[rows, at].astype(np.int64)
        right[rows, at] = after
        has = after < slots
        left[rows[has], after[has]] = at[has]
        # Three leaves change: the removed symbol's, the merged one's and the one before it.
        value = np.full(len(rows), _NONE)
        value[has] = vocab.rank(ids[rows[has], at[has]], ids[rows[has], after[has]])
        value = np.where(value == _NONE, _NONE, (value << _PLACE_BITS) | at)
        fore = before >= 0
        prior = np.full(len(rows), _NONE)
        prior[fore] = vocab.rank(ids[rows[fore], before[fore]], ids[rows[fore], at[fore]])
        prior = np.where(prior == _NONE, _NONE, (prior << _PLACE_BITS) | np.maximum(before, 0))
        shut = gone < leaves
        _update(tree, leaves, rows[shut], gone[shut], np.full(shut.sum(), _NONE))
        live = at < leaves
        _update(tree, leaves, rows[live], at[live], value[live])
        _update(tree, leaves, rows[fore], before[fore], prior[fore])
        rows = rows[tree[rows, root] < _NONE]
    alive = ids >= 0
    return alive.sum(1), ids[alive]


def _merge_long(vocab: Vocabulary, data: np.ndarray, leaves: int) -> np.ndarray:
    """The ids of one long piece. The root's pair is merged at all its places, from the left: a merge makes no pair of its own or
    a lower rank, as a pair that holds the new symbol was learnt after it. The places are found by going down the tree where the
    least rank lies; the leaves that change are set together, and their ancestors level by level."""
    n = len(data)
    ids = vocab.byte_ids[data].astype(np.int64)
    right, left = np.arange(1, n + 1), np.arange(-1, n - 1)  # n stands for none
    tree = np.full(2 * leaves, _NONE)

    def leaf(at: np.ndarray) -> np.ndarray:
        value = np.full(len(at), _NONE)
        live = np.flatnonzero(right[at] < n)
        rank = vocab.rank(ids[at[live]], ids[right[at[live]]])
        value[live] = np.where(rank == _NONE, _NONE, (rank << _PLACE_BITS) | at[live])
        return value

    tree[leaves : leaves + n - 1] = leaf(np.arange(n - 1))
    level = leaves
    while level > 1:
        level >>= 1
        tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
    while tree[1] < _NONE:
        rank = tree[1] >> _PLACE_BITS
        node = np.ones(1, np.int64)
        while node[0] < leaves:
            node = np.stack([2 * node, 2 * node + 1], 1).ravel()
            node = node[tree[node] >> _PLACE_BITS == rank]
        at = node - leaves
        # Of places that follow each other (the same symbol again and again) every second one is taken.
        chain = np.append(True, right[at[:-1]] != at[1:])
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(chain, place, 0))) % 2 == 0]
        gone = right[at]
        after = right[gone]
        ids[at], ids[gone], right[at] = vocab.merged[rank], -1, after
        left[after[after < n]] = at[after < n]
        before = left[at]
        changed = np.unique(np.concatenate([at[at < n - 1], before[before >= 0]]))
        gone = gone[gone < leaves]
        tree[leaves + gone] = _NONE
        tree[leaves + changed] = leaf(changed)
        node = np.unique(np.concatenate([gone, changed]) + leaves >> 1)
        while node[0]:
            tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
            node = np.unique(node >> 1)
    return ids[ids >= 0].astype(np.int32)


def _update(tree: np.ndarray, leaves: int, rows: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
    """Point update: set the leaf and recompute its ancestors."""
    node = leaves + place
    tree[rows, node] = value
    node >>= 1
    while len(node) and node[0] >= 1:
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        node >>= 1


_encoders: dict[str, Encoder] = {}


def encoder(vocab: Vocabulary) -> Encoder:
    """One for each worker process and vocabulary: what it has learnt serves the later tasks too."""
    if vocab.digest not in _encoders:
        _encoders.clear()
        _encoders[vocab.digest] = Encoder(vocab)
    return _encoders[vocab.digest]


def vocabulary_path(name: str = DEFAULT_NAME, folder: str = DEFAULT_DIR) -> str:
    return f"{folder}/{name}.json"


def token_ids(df: DataFrame, text: str, path: str, into: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all but text) and into: the token ids of text, [] for null and empty texts."""
    names = [c for c in (df.columns if keep is None else keep) if c != into and (keep is not None or c != text)]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(into, T.ArrayType(T.IntegerType()))])
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))  # bounded by the vocabulary: only the driver reads the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for part in blocks(batch, text):
                ids, offsets = own.encode(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists], [*names, into])

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])]).mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str, path: str, into: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all but text) and into: the number of tokens of text, 0 for null and empty texts."""
    names = [c for c in (df.columns if keep is None else keep) if c != into and (keep is not None or c != text)]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(into, T.LongType())])
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))  # bounded by the vocabulary: only the driver reads the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for part in blocks(batch, text):
                counts = pa.array(own.count(part.column(text)))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), counts], [*names, into])

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])]).mapInArrow(run, schema)
