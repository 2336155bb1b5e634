"""Arrow string columns as numpy code-point arrays and back, a whole block of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows are handled in blocks of about this many UTF-8 bytes; a longer row is a block of its own.
BLOCK_BYTES = 1 << 21


#: Ranges of code points that hold all assigned characters but private ones: tables need to look at no others.
ASSIGNED = (range(0x0, 0xD800), range(0xF900, 0x33480), range(0xE0000, 0xE0200))


def assigned() -> Iterator[int]:
    for part in ASSIGNED:
        yield from part


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about size bytes each (at least one row)."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def to_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in a row, and the offsets (rows + 1) of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    byte_offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = data.to_pybytes()[byte_offsets[0] : byte_offsets[-1]] if data is not None and len(column) else b""
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    return codes, offsets


def utf8_sizes(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return (1 + (codes > 0x7F).view(np.int8) + (codes > 0x7FF).view(np.int8) + (codes > 0xFFFF).view(np.int8)).astype(np.int8)


def to_arrow(codes: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The reverse of to_codes: a string array; rows that are not valid come out null."""
    raw = codes.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(utf8_sizes(codes), out=ends[1:])
    bounds = ends[offsets].astype(np.int32)
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw), mask)


def valid_rows(column: pa.Array) -> np.ndarray:
    return pc.is_valid(column).to_numpy(zero_copy_only=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input changes about half of the output's."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses, modulo 2 ** 64; kept and grown."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 21)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run codes[start:end]: a polynomial of well-mixed code points, by prefix sums of the whole block."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(codes))
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_values()[codes] * up[: len(codes)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))


def whitespace_table() -> np.ndarray:
    """True at the code points with the Unicode property White_Space."""
    # The White_Space property.
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out = np.zeros(0x110000, bool)
    out[spaces] = True
    return out


def word_runs(codes: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space within rows, and the row of each."""
    solid = ~space[codes]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(codes)]
    head[inner] = solid[inner]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    last = inner[inner > 0] - 1
    tail[last] = solid[last]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows
