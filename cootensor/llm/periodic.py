"""Periodic run detection by internal pattern matching, and the texts without their repetitions.

A run is a longest stretch of words in which words ``q`` apart are identical, ``q`` its
smallest such distance, at least ``MIN_WORDS`` words and ``MIN_TIMES`` periods long.

The words of a chunk of texts are one sequence, coded by (text, word) with a mark after
each text, so nothing equal crosses texts.  Prefix doubling gives the suffix array and,
on the way, the names of all stretches of 1, 2, 4, ... words; equal names are equal
stretches, so a longest common extension is a walk down the levels.  A wavelet matrix
over the suffix array answers range successor queries: the next place from ``x`` on
where a block occurs.

* Periods below 4 * ``BLOCK``: every aligned block of ``BLOCK`` = 8 words asks for its
  occurrences in the next 31 places.  A run has at least 24 words and 3 periods, so it
  holds an aligned block and that block's copy one period on.
* Periods in [2m, 4m), m = 16, 32, ...: aligned blocks of m words ask for occurrences
  between 2m and 4m places on.  Occurrences at most m / 2 apart form a progression whose
  difference d is the block's own period.  Either the progression is the stretch that
  holds the block, and then no period of a run is in it, or a run maps the end of the
  block's d-periodic stretch to the end of the progression's, and the difference of the
  two ends is the only candidate.  So a block has a handful of candidates.

Each candidate is extended both ways by names, which settles its run exactly; of equal
stretches the smallest period stays.  Work is n log n per text for any text.  Memory is
4 bytes per word and level (levels: log2 of the longest repeat inside one text) for a
chunk of ``text.CHUNK`` bytes, or for one text if it is longer.

Null or empty texts, or texts of white space, have no words, no runs and an empty
collapsed text.  Very long texts are a chunk of their own.  Repeated rows are answered
each; ties of runs cannot occur (no two runs share both ends).  An empty table gives an
empty result.  Columns kept travel in the struct ``row``, so no name clashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import annotate
from .text import SPACED, Words, buffers, chunks

BLOCK = 8
MIN_WORDS = 24
MIN_TIMES = 3

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_array(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words as one Arrow string array, and each row's word range."""
    w = Words(data, off, SPACED, lower=False, hashes=False)
    ends = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(w.end - w.start, out=ends[1:])
    body = np.ascontiguousarray(data[SPACED[data]])
    words = pa.Array.from_buffers(pa.large_string(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return words, w.row


def suffixes(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``key`` and the names of its stretches of 1, 2, 4, ... items.

    A name is the first place of its class in suffix order.  Every stretch that reaches
    an item occurring once is alone in its class, so sorting stops at the longest repeat.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    act, new = np.arange(n), np.ones(n, bool)
    np.not_equal(key[order][1:], key[order][:-1], out=new[1:])
    names, h = [], 1
    while True:
        first = np.maximum.accumulate(np.where(new, act, 0))
        rank[order[act]] = first
        names.append(rank.copy())
        shared = ~(new & np.append(new[1:], True))
        act = act[shared]
        if not len(act):
            return order, names
        pos = order[act]
        pair = rank[pos].astype(np.int64) * n + rank[pos + h]
        o = np.argsort(pair, kind="stable")
        order[act], pair = pos[o], pair[o]
        new = np.ones(len(act), bool)
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        h *= 2


def ahead(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal items from ``i`` and from ``j`` on."""
    i, j, start = i.copy(), j.copy(), i
    for k in range(len(names) - 1, -1, -1):
        step = (names[k][i] == names[k][j]).astype(np.int64) << k
        i += step
        j += step
    return i - start


def behind(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal items just before ``i`` and just before ``j`` (i < j)."""
    i, j, start = i.copy(), j.copy(), i
    for k in range(len(names) - 1, -1, -1):
        fits = i >= 1 << k
        step = (fits & (names[k][np.where(fits, i - (1 << k), 0)] == names[k][np.where(fits, j - (1 << k), 1)])).astype(np.int64) << k
        i -= step
        j -= step
    return start - i


class Successor:
    """Wavelet matrix over a sequence of distinct numbers: the smallest one from ``x`` on inside a range."""

    def __init__(self, values: np.ndarray, top: int):
        self.zeros, self.top = [], top
        for b in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (values >> b) & 1 == 1
            z = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~one, out=z[1:])
            self.zeros.append((b, z))
            values = np.concatenate([values[~one], values[one]])

    def _below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        n = np.zeros(len(x), np.int64)
        for b, z in self.zeros:
            zl, zr, one = z[lo], z[hi], (x >> b) & 1 == 1
            n += np.where(one, zr - zl, 0)
            lo, hi = np.where(one, z[-1] + lo - zl, zl), np.where(one, z[-1] + hi - zr, zr)
        return n

    def __call__(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        nth = self._below(lo, hi, np.minimum(x, self.top))
        found = nth < hi - lo
        out, nth = np.zeros(len(x), np.int64), np.where(found, nth, 0)
        for b, z in self.zeros:
            zl, zr = z[lo], z[hi]
            one = nth >= zr - zl
            nth -= np.where(one, zr - zl, 0)
            out += one.astype(np.int64) << b
            lo, hi = np.where(one, z[-1] + lo - zl, zl), np.where(one, z[-1] + hi - zr, zr)
        return np.where(found, out, none)


def candidates(order: np.ndarray, names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances (s, q) such that every run holds some s and s + q inside, with its period as q."""
    n, level = len(order), BLOCK.bit_length() - 1
    none = 4 * n
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(names) <= level:
        return found[0]
    size = np.bincount(names[level], minlength=n)
    kept = size[names[level][order]] > 1
    at = np.zeros(n + 1, np.int64)
    np.cumsum(kept, out=at[1:])
    if not at[-1]:
        return found[0]
    successor = Successor(order[kept].astype(np.int64), n)
    for k in range(level, len(names)):
        m = 1 << k
        if k > level:
            size = np.bincount(names[k], minlength=n)
        s = np.arange(0, n, m)
        s = s[size[names[k][s]] > 1]
        lo = names[k][s].astype(np.int64)
        lo, hi = at[lo], at[lo + size[lo]]
        base = k == level
        x, end = s + (1 if base else 2 * m), s + 4 * m
        while len(s):
            p = successor(lo, hi, x, none)
            on = p < end
            s, lo, hi, end, p = s[on], lo[on], hi[on], end[on], p[on]
            if base:
                found.append((s, p - s))
                x = p + 1
                continue
            p2 = successor(lo, hi, p + 1, none)
            d = p2 - p
            row = d <= m // 2
            found.append((s[~row], (p - s)[~row]))
            x = p + 1
            if row.any():
                a, b, c = s[row], p[row], d[row]
                mine, theirs = a + c + ahead(names, a, a + c), b + c + ahead(names, b, b + c)
                apart = theirs > mine
                found.append((a[apart], (theirs - mine)[apart]))
                x[row] = theirs - m + 1
    s, q = (np.concatenate(v) for v in zip(*found))
    return s, q


def all_runs(key: np.ndarray) -> np.ndarray:
    """Runs of ``key`` (whose last item occurs once) as rows (start, end, period), ordered by start and period."""
    order, names = suffixes(key)
    s, q = candidates(order, names)
    ok = s + q < len(key)
    s, q = s[ok], q[ok]
    start, end = s - behind(names, s, s + q), s + q + ahead(names, s, s + q)
    ok = end - start >= np.maximum(MIN_WORDS, MIN_TIMES * q)
    got = np.unique(np.stack([start[ok], end[ok], q[ok]], 1), axis=0)
    new = np.ones(len(got), bool)
    new[1:] = (got[1:, :2] != got[:-1, :2]).any(1)
    got = got[new]
    return got[np.lexsort((got[:, 2], got[:, 0]))]


def _echo(src: np.ndarray, rows: np.ndarray, h: np.ndarray) -> None:
    """Let texts whose ``h`` ends in 0 repeat a stretch: word i >= a becomes word a + (i - a) % p."""
    for d in np.flatnonzero(h % 10 == 0):
        b, n, g = int(rows[d]), int(rows[d + 1] - rows[d]), int(h[d]) // 10
        if n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            src[b + a:b + n] = b + a + np.arange(n - a) % p


def _collapse(data: np.ndarray, off: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """Word counts, runs (start, length, period) and kept words of the rows of one chunk."""
    words, rows = word_array(data, off)
    n_rows = len(rows) - 1
    count = np.diff(rows)
    src = np.arange(len(words))
    _echo(src, rows, h)
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[src] + 1
    doc = np.repeat(np.arange(n_rows), count)
    wide = int(code.max(initial=0)) + 1
    place = np.arange(len(words)) + doc                      # one mark follows each text
    key = np.arange(n_rows).repeat(count + 1) * wide
    key[place] += code
    runs = all_runs(key)
    first = rows[:-1] + np.arange(n_rows)                     # place of each text's first word
    of = np.searchsorted(first, runs[:, 0], "right") - 1
    start, length, period = runs[:, 0] - first[of], runs[:, 1] - runs[:, 0], runs[:, 2]
    drop = np.zeros(len(words) + 1, np.int64)
    base = rows[of] + start
    np.add.at(drop, base + period, 1)
    np.add.at(drop, base + length, -1)
    keep = np.cumsum(drop[:-1]) == 0
    left = np.zeros(len(words) + 1, np.int64)
    np.cumsum(keep, out=left[1:])
    text = pc.binary_join(pa.LargeListArray.from_arrays(left[rows], words.take(pa.array(src[keep]))), pa.scalar(" ", pa.large_string()))
    cut = np.searchsorted(of, np.arange(n_rows + 1))
    told = np.stack([start, length, period], 1)
    return count, [told[a:b] for a, b in zip(cut[:-1], cut[1:])], text


def _run(batch: pa.RecordBatch) -> list:
    data, off = buffers(batch["text"])
    h = batch["echo"].fill_null(1).to_numpy(zero_copy_only=False)
    counts, runs, texts = [np.zeros(0, np.int64)], [], []
    for i, j in chunks(off):
        n, r, t = _collapse(data[off[i]:off[j]], off[i:j + 1] - off[i], h[i:j])
        counts.append(n)
        runs += r
        texts.append(t.cast(pa.string()))
    flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
    ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    told = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(RUN)))
    return [np.concatenate(counts), told, pa.concat_arrays(texts)]


def scan(docs: DataFrame, keep: list[str], text: Column | None = None, echo: Column | None = None) -> DataFrame:
    """Rows ``(row, n_words, runs, collapsed)``.

    ``runs`` lists (start, length, period) in words by start, then period; ``collapsed``
    is the text's words joined by one space, without those that stand in a run after its
    first period.  ``echo`` (a long per row) plants a repetition first, as ``_echo`` says;
    without it, or where it is null, texts are read as they are.
    """
    return annotate(docs, keep, {"text": F.col("text") if text is None else text,
                                 "echo": (F.lit(1) if echo is None else echo).cast("long")}, _run,
                    "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; then the smallest start and period.  Null without runs."""
    def better(best: Column, r: Column) -> Column:
        a, b = r["length"] * best["period"], best["length"] * r["period"]
        return F.when(best.isNull() | (a > b), r).otherwise(best)      # runs come by start, then period
    kind = "struct<start: long, length: long, period: long>"
    return F.aggregate(runs, F.lit(None).cast(kind), lambda best, r: better(best, r))
