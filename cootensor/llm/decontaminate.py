"""Benchmark decontamination by multi-pattern search over words (Wu-Manber).

A benchmark item is cut into windows of ``size`` consecutive words (an item of
fewer words, but not none, is one window).  All windows of one length form one
pattern set:

* a block shift table over hashed blocks of up to three words says how far the
  search may jump when the block at the current position ends no window;
* where the shift is zero, the suffix-hash bucket of that block selects the few
  windows ending with it;
* the words themselves are compared to confirm an occurrence.

Texts are searched in lanes (stretches of one document, overlapping by one
window) that all jump at once, so skipping works inside numpy.

Defined results.  Null or empty text: no words, not contaminated.  A benchmark
item without words or with null text has no window.  A null ``item_id`` marks
words but names no item.  Repeated items or rows count once per id / are kept
row by row.  An empty benchmark or table gives zeros / no rows.  Very long texts
are searched whole.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import annotate, cut
from .text import ALNUM, U64, Words, buffers, chunks, rows_of

WINDOW = 10
BLOCK_BYTES = 64 << 20     # benchmark text held by one broadcast pattern set
LANE = 512                 # words a lane searches
_BITS = 18
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U64)

RESULTS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _block(h: np.ndarray, end: np.ndarray, b: int) -> np.ndarray:
    """Slot of the block of b words that ends at each position."""
    acc = np.zeros(len(end), U64)
    for j in range(b):
        acc += h[end - j] * _C[j]
    return (acc >> U64(64 - _BITS)).astype(np.int64)


@dataclass
class PatternSet:
    """Windows of one length with their shift table and suffix buckets."""

    m: int
    b: int
    words: np.ndarray       # windows x m word hashes, ordered by suffix slot
    shift: np.ndarray       # 2^_BITS block shifts
    bucket: np.ndarray      # 2^_BITS + 1 offsets into words
    item_at: np.ndarray     # offsets of each window's items
    items: np.ndarray

    @classmethod
    def build(cls, windows: np.ndarray, owner: np.ndarray) -> PatternSet:
        m = windows.shape[1]
        b = min(3, m)
        distinct, inverse = np.unique(windows, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        flat, n = distinct.ravel(), len(distinct)
        base = np.arange(n) * m
        shift = np.full(1 << _BITS, m - b + 1, np.int64)
        for end in range(b - 1, m):                  # later block ends give smaller shifts
            shift[_block(flat, base + end, b)] = m - 1 - end
        slot = _block(flat, base + m - 1, b)
        order = np.argsort(slot, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        own = np.unique(np.stack([rank[inverse], owner], 1), axis=0)
        return cls(m, b, distinct[order], shift,
                   np.searchsorted(slot[order], np.arange((1 << _BITS) + 1)),
                   np.searchsorted(own[:, 0], np.arange(n + 1)), own[:, 1])

    def find(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in the word ranges ``rows``."""
        m, none = self.m, np.zeros(0, np.int64)
        lo, hi = rows[:-1], rows[1:]
        n_lane = np.maximum(0, -(-(hi - lo - m + 1) // LANE))
        row = np.repeat(np.arange(len(lo)), n_lane)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n_lane) - n_lane, n_lane)
        p = lo[row] + k * LANE + m - 1               # the last word of the window looked at
        stop = np.minimum(p + LANE, hi[row])
        slot = np.zeros(len(h), np.int64)
        if len(h) >= self.b:
            slot[self.b - 1:] = _block(h, np.arange(self.b - 1, len(h)), self.b)
        found = []
        while len(p):
            s = self.shift[slot[p]]
            found.append(p[s == 0])
            p = p + np.maximum(s, 1)
            on = p < stop
            p, stop = p[on], stop[on]
        end = np.concatenate(found) if found else none
        first = self.bucket[slot[end]]
        n = self.bucket[slot[end] + 1] - first
        end = np.repeat(end, n)
        w = np.arange(len(end)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        for j in range(m):                           # direct comparison, word by word
            same = h[end - j] == self.words[w, m - 1 - j]
            end, w = end[same], w[same]
        return end - m + 1, w


def compile_patterns(items: pa.Table, size: int = WINDOW) -> tuple[list[PatternSet], list[str | None]]:
    """Pattern sets, one per window length, of items ``(item_id, text)``, and the item ids."""
    data, off = buffers(items["text"])
    words = Words(data, off, ALNUM)
    by_len: dict[int, list] = {}
    for i, (a, b) in enumerate(zip(words.row[:-1], words.row[1:])):
        m = min(size, b - a)
        for k in range(a, b - m + 1) if m else ():
            by_len.setdefault(int(m), []).append((words.hash[k:k + m], i))
    sets = [PatternSet.build(np.stack([w for w, _ in v]), np.array([i for _, i in v], np.int64))
            for _, v in sorted(by_len.items())]
    return sets, [None if x is None else str(x) for x in items["item_id"].to_pylist()]


def _search(col, sets: list[PatternSet]):
    """Per row: word count, hit word indexes, item numbers."""
    data, off = buffers(col)
    for i, j in chunks(off):
        words = Words(data[off[i]:off[j]], off[i:j + 1] - off[i], ALNUM)
        n = len(words.hash)
        mark = np.zeros(n + 1, np.int64)
        row = rows_of(words.row)
        pairs = [np.zeros((0, 2), np.int64)]
        for ps in sets:
            first, w = ps.find(words.hash, words.row)
            np.add.at(mark, first, 1)
            np.add.at(mark, first + ps.m, -1)
            k = ps.item_at[w + 1] - ps.item_at[w]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(ps.item_at[w], k)
            pairs.append(np.stack([np.repeat(row[first], k), ps.items[at]], 1))
        hit = np.cumsum(mark[:-1]) > 0
        pairs = np.unique(np.concatenate(pairs), axis=0)
        at = np.searchsorted(pairs[:, 0], np.arange(j - i + 1))
        for r in range(j - i):
            a, b = words.row[r], words.row[r + 1]
            yield int(b - a), np.flatnonzero(hit[a:b]), pairs[at[r]:at[r + 1], 1]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text",
         size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(row, n_words, n_hit, n_items, items_sha256, contaminated)`` for every document.

    The benchmark is a query set: it is split by hash into blocks of about
    ``block_bytes`` of text, each block is compiled and broadcast on its own, and
    all documents are searched against every block.  Hits found so far travel
    with the document from block to block, so the result is the same for any
    number of blocks.
    """
    spark = docs.sparkSession
    bench = benchmark.select("item_id", "text").where("text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(text).alias("text"),
                        F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("names"))
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(compile_patterns(bench.where(part == k).toArrow(), size))
        last = k == blocks - 1

        def run(b: pa.RecordBatch, shared=shared, last=last):
            sets, ids = shared.value
            before = zip(b.column("hits").to_pylist(), b.column("names").to_pylist())
            rows = []
            for (n, hit, own), (hits, names) in zip(_search(b.column("text"), sets), before):
                if hits is not None:
                    hit = np.union1d(hit, np.frombuffer(hits, np.int64))
                names = {*(names or ()), *(ids[x] for x in own if ids[x] is not None)}
                if last:
                    sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
                    rows.append((n, len(hit), len(names), sha, len(hit) > 0))
                else:
                    rows.append((hit.astype(np.int64).tobytes(), sorted(names)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] if last else \
                [pa.binary(), pa.list_(pa.string())]
            return [pa.array(v, t) for v, t in zip(zip(*rows), kinds)]

        inputs = {c: F.col(c) for c in ("text", "hits", "names")}
        if last:
            state = annotate(state, ["kept"], inputs, run, RESULTS)
        else:
            done = annotate(state, ["kept", "text"], inputs, run, "hits binary, names array<string>")
            state = cut(done.select("row.*", "hits", "names"), "decontam")
    return state.withColumn("row", F.col("row.kept"))
