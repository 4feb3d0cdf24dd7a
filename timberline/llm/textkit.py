"""Vectorised word splitting and hashing over Arrow text columns.

A slice of rows is handled as one byte buffer. Words are found by comparing
byte classes, and hashed without a Python loop: with S the running sum of
``T[byte] * B**i`` (mod 2**64), the sum over any byte range times ``B**-start``
depends on its bytes only. Word sequences are hashed the same way, one level up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240131))
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE, _SEQ = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.full(size, U(base))
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
        if size > 8 * SLICE_BYTES:
            del _POWERS[base]  # a very long text; the table isn't kept
    return have


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def range_hash(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair; equal ranges hash alike."""
    n = len(values)
    total = np.zeros(n + 1, U)
    np.cumsum(values * _powers(base, n + 1)[:n], out=total[1:])
    inv = _powers(_inverse(base), n + 1)
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))


@dataclass
class Words:
    """The words of some rows. ``first[r]:first[r + 1]`` are the words of row r."""

    data: np.ndarray  # bytes of the slice
    start: np.ndarray  # byte range of each word in data
    end: np.ndarray
    first: np.ndarray
    bytes_at: np.ndarray  # byte range of each row: bytes_at[r]:bytes_at[r + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Of the words, or of the given byte ranges."""
        start, end = (self.start, self.end) if start is None else (start, end)
        if not len(start):
            return np.zeros(0, U)
        return range_hash(_TABLE[self.data], _BASE, start, end)

    def sequence_hash(self, word_hash: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        if not len(start):
            return np.zeros(0, U)
        return range_hash(word_hash, _SEQ, start, start + length)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    at = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def split_words(col: pa.Array, lower: bool = False, breaks: np.ndarray = SPACE) -> Words:
    """Words are the longest runs of bytes outside ``breaks``, within a row."""
    data, at = column_bytes(col)
    return split_bytes(LOWER[data] if lower else data, at, breaks)


def split_bytes(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~breaks[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = at[1:-1]  # a row that ends within a word cuts it
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    if len(cut):
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return Words(data, start, end, np.searchsorted(start, at, side="left"), at)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece come to about ``limit`` bytes;
    a single longer text is a piece of its own."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        _, at = column_bytes(batch.column(k))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def texts(col: pa.Array) -> list[bytes]:
    """Each text as bytes; null is empty."""
    data, at = column_bytes(col)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
