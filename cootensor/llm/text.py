"""Vectorised text helpers shared by the corpus operators.

A batch of texts is handled as one UTF-8 byte buffer with row boundaries; words
are byte runs, hashed all at once, so a task's Python cost is a few numpy
passes over its bytes instead of a loop over its words.  Buffers are cut at row
boundaries into chunks of about ``CHUNK`` bytes (a longer text is one chunk), so
memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U64 = np.uint64

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POW = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Boolean table over byte values, true inside the inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a:b + 1] = True
    return t


# [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
SPACED = ~byte_class([(9, 13), (32, 32)])
ALNUM = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = max(n, 2 * CHUNK)
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(m, base, U64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # several chunks stay apart above 2 GB
        col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``size`` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """Words of rows [i, j): byte start / end inside ``buf``, 64-bit hash, and each row's word range."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = True, hashes: bool = True):
        self.buf = LOWER[data] if lower else data
        n = len(self.buf)
        w = table[self.buf]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        cut = off[:-1][off[:-1] < off[1:]]          # first byte of every non-empty row
        first[cut] = w[cut]
        last[cut[1:] - 1] = w[cut[1:] - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        if n and hashes:
            p, q = _powers(n)
            acc = np.zeros(n + 1, U64)
            np.cumsum(_BYTE[self.buf] * p, out=acc[1:])
            raw = (acc[self.end] - acc[self.start]) * q[self.start]
            self.hash = mix(raw + (self.end - self.start).astype(U64))
        else:
            self.hash = np.zeros(0, U64)
        self.offsets = off
        self.row = np.searchsorted(self.start, off)  # word range of row r: row[r] .. row[r + 1]


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of every word for word ranges ``bounds`` (n + 1)."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


_SHINGLE = mix(np.arange(1, 65, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def ngram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (row boundaries are the caller's concern)."""
    n = max(0, len(h) - k + 1)
    acc = np.full(n, k, U64)
    for j in range(k):
        acc += h[j:j + n] * _SHINGLE[j]
    return mix(acc)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct k-word shingle hashes.

    A row with fewer than k words, but not none, has its whole word sequence as
    the one shingle; a row without words has none.
    """
    g = ngram_hash(words.hash, k)
    for a, b in zip(words.row[:-1], words.row[1:]):
        if b - a >= k:
            yield np.unique(g[a:b - k + 1])
        elif b > a:
            yield ngram_hash(words.hash[a:b], int(b - a))
        else:
            yield np.zeros(0, U64)
