"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The frequent words of the corpus (counted on Spark) are compiled into a minimal
acyclic automaton: equal suffixes share states, every arc carries a number, and
the numbers along a word's path add up to the word's place in a pool of token
ids.  The compiled table is one flat file that workers memory-map.  Words the
lexicon lacks are merged exactly by the tokenizer's merge ranks, all such words
of a chunk at once (long ones one by one with a heap).

The tokenizer file is read, never trained.  Supported is the kind with byte
symbols and a word-end mark: NFC, white space removed, lower case per character,
pieces ``'s 't 're 've 'm 'll 'd``, letter runs, single numerals, runs of other
characters; special tokens are found in the raw text first.

Defined results.  Null or empty text: no tokens, decoded to the empty text.
White space alone likewise.  Very long texts and pieces are encoded whole.
Repeated rows and rows with null ids are encoded row by row; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import annotate, cut, most_counted
from .text import U64, buffers, chunks, mix

LEXICON_WORDS = 50_000     # words compiled into the lexicon
MIN_IN_CHUNK = 3           # a chunk reports the words it has at least so often
TEXT_CHUNK = 1 << 21
LONG_PIECE = 64            # bytes; longer pieces are merged one by one
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"

# Fixed values of the byte-level alphabet: bytes that stand for themselves.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Code points with the White_Space property.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    spare = iter(range(256, 512))
    return [chr(b) if b in _PLAIN else chr(next(spare)) for b in range(256)]


class _Unicode:
    """Per code point: class (0 space, 1 letter, 2 numeral, 3 other), lower case, hash, UTF-8 length."""

    _one: _Unicode | None = None

    def __init__(self):
        n = 0x110000
        kind = {"L": 1, "N": 2}
        self.cls = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 3) for c in range(n)), np.uint8, n)
        self.cls[_SPACES] = 0
        self.lower = np.arange(n, dtype=np.uint32)
        for c in np.flatnonzero(self.cls != 0).tolist():
            if 0xD800 <= c < 0xE000:
                continue
            low = chr(c).lower()
            if len(low) == 1:
                self.lower[c] = ord(low)
        self.hash = mix(np.arange(1, n + 1, dtype=U64))
        c = np.arange(n)
        self.width = (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)).astype(np.int64)

    @classmethod
    def get(cls) -> _Unicode:
        if cls._one is None:
            cls._one = cls()
        return cls._one


_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, base: int, store: dict = {}) -> np.ndarray:  # noqa: B006 - cache
    p = store.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, TEXT_CHUNK), base, U64)
        p[0] = 1
        p = store[base] = np.multiply.accumulate(p)
    return p[:n]


class Pieces:
    """Pre-tokenized pieces of a list of text segments."""

    def __init__(self, segments_utf8: bytes, off: np.ndarray):
        u = _Unicode.get()
        data = np.frombuffer(segments_utf8, np.uint8)
        if (data >= 0xCC).any() or b"\xc4\xb0" in segments_utf8:   # may not be NFC, or has the one letter whose lower case is two
            segs = [unicodedata.normalize("NFC", segments_utf8[a:b].decode("utf-8", "replace")).replace("İ", "i̇")
                    .encode() for a, b in zip(off[:-1], off[1:])]
            segments_utf8, off = b"".join(segs), np.concatenate([[0], np.cumsum([len(s) for s in segs], dtype=np.int64)])
            data = np.frombuffer(segments_utf8, np.uint8)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.off = off = lead[off]
        cp = np.frombuffer(segments_utf8.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        self.cp = cp = u.lower[cp]
        n = len(cp)
        cls = u.cls[cp]
        before = np.empty(n, np.uint8)
        before[1:] = cls[:-1]
        if n:
            before[0] = 0
        edge = np.zeros(n + 1, bool)
        edge[off[:-1]] = True
        start = (cls > 0) & ((cls != before) | (cls == 2) | edge[:n])
        for i in np.flatnonzero(start & (cp == 39)).tolist():
            for tail in _CONTRACTIONS:
                end = i + 1 + len(tail)
                if end <= n and not edge[i + 1:end].any() and all(cp[i + 1 + k] == ord(ch) for k, ch in enumerate(tail)):
                    start[i + 1] = False
                    if end < n and cls[end] == 1 and not edge[end]:
                        start[end] = True
                    break
        self.start = np.flatnonzero(start)
        stop = np.flatnonzero(np.append(start | (cls == 0) | edge[:n], True))
        self.end = stop[np.searchsorted(stop, self.start, "right")]
        self.row = np.searchsorted(self.start, off)
        acc = np.zeros(n + 1, U64)
        np.cumsum(u.hash[cp] * _powers(n, _BASE), out=acc[1:])
        raw = (acc[self.end] - acc[self.start]) * _powers(n + 1, pow(_BASE, -1, 1 << 64))[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(U64))

    def utf8(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of the pieces ``which``."""
        n = self.end[which] - self.start[which]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[which], n)
        cp = self.cp[at]
        width = np.concatenate([[0], np.cumsum(_Unicode.get().width[cp])])
        data = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        return data, width[np.concatenate([[0], np.cumsum(n)])]


def _hash_slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


def _fill(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Open-addressing table of key numbers (-1: free) for distinct ``keys``."""
    bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
    table = np.full(1 << bits, -1, np.int64)
    todo, slot = np.arange(len(keys)), _hash_slots(keys, bits)
    while len(todo):
        free = table[slot] < 0
        table[slot[free]] = todo[free]                   # the last writer of a slot stays
        placed = table[slot] == todo
        todo, slot = todo[~placed], (slot[~placed] + 1) & ((1 << bits) - 1)
    return table, bits


def _probe(table: np.ndarray, bits: int, keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Number of each wanted key, -1 where absent."""
    out = np.full(len(want), -1, np.int64)
    slot, idx = _hash_slots(want, bits), np.arange(len(want))
    while len(idx):
        got = table[slot]
        same = (got >= 0) & (keys[got] == want[idx])
        out[idx[same]] = got[same]
        on = (got >= 0) & ~same
        idx, slot = idx[on], (slot[on] + 1) & ((1 << bits) - 1)
    return out


@dataclass
class Tokenizer:
    """Vocabulary and merges of a tokenizer file (bounded by that file)."""

    tokens: list[bytes]                 # by id, as decode() shows them
    special: dict[str, int]
    first: np.ndarray                   # id of each byte inside a word
    final: np.ndarray                   # id of each byte at a word's end
    pair: np.ndarray                    # left << 16 | right, by merge rank
    merged: np.ndarray
    _table: tuple | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for t, i in [*vocab.items(), *special.items()]:
            tokens[i] = t.encode()
        symbols = byte_symbols()
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in
                 (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        p = np.array(pairs, np.int64).reshape(-1, 3)
        return cls(tokens, special, np.array([vocab[s] for s in symbols]), np.array([vocab[s + suffix] for s in symbols]),
                   p[:, 0] << 16 | p[:, 1], p[:, 2])

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = _fill(self.pair)
        r = _probe(*self._table, self.pair, (left.astype(np.int64) << 16) | right)
        return np.where(r < 0, len(self.pair), r)

    def merge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and offsets of words given as UTF-8: the exact merges, lowest rank first, leftmost among equals."""
        n = np.diff(off)
        ids = [np.zeros(0, np.int64)]
        who = [np.zeros(0, np.int64)]
        lo = 0
        for hi in (4, 8, 12, 16, 24, 32, LONG_PIECE):
            sel = np.flatnonzero((n > lo) & (n <= hi))
            for k in range(0, len(sel), 1 << 14):
                got, size = self._merge_block(data, off, sel[k:k + (1 << 14)], hi)
                ids.append(got)
                who.append(np.repeat(sel[k:k + (1 << 14)], size))
            lo = hi
        for i in np.flatnonzero(n > LONG_PIECE).tolist():
            got = self._merge_long(data[off[i]:off[i + 1]])
            ids.append(got)
            who.append(np.full(len(got), i))
        ids, who = np.concatenate(ids), np.concatenate(who)
        order = np.argsort(who, kind="stable")
        return ids[order], np.searchsorted(who[order], np.arange(len(n) + 1))

    def _merge_block(self, data, off, sel, width):
        n = off[sel + 1] - off[sel]
        col = np.arange(width)
        at = np.minimum(off[sel][:, None] + col, len(data) - 1)
        tok = np.where(col < n[:, None], self.first[data[at]], 0)
        r = np.arange(len(sel))
        tok[r, n - 1] = self.final[data[off[sel + 1] - 1]]
        none = len(self.pair)
        rank = np.full((len(sel), width), none)
        on = col[1:] < n[:, None]
        rank[:, :-1][on] = self.rank(tok[:, :-1][on], tok[:, 1:][on])
        size, live = n.copy(), r
        tk, rk, sz = tok, rank, n.copy()
        while True:
            p = rk.argmin(1)
            ok = rk[np.arange(len(p)), p] < none
            if not ok.all():
                tok[live[~ok]], size[live[~ok]] = tk[~ok], sz[~ok]
                live, tk, rk, sz, p = live[ok], tk[ok], rk[ok], sz[ok], p[ok]
            if not len(live):
                break
            i = np.arange(len(p))
            m = self.merged[rk[i, p]]
            after = col > p[:, None]                       # what follows moves one place left
            moved = np.concatenate([tk[:, 1:], np.zeros((len(p), 1), tk.dtype)], 1)
            tk = np.where(after, moved, tk)
            tk[i, p] = m
            moved = np.concatenate([rk[:, 1:], np.full((len(p), 1), none)], 1)
            rk = np.where(after, moved, rk)
            sz = sz - 1
            right = p + 1 < sz
            rk[i, p] = none
            rk[i[right], p[right]] = self.rank(m[right], tk[i[right], p[right] + 1])
            left = p > 0
            rk[i[left], p[left] - 1] = self.rank(tk[i[left], p[left] - 1], m[left])
        return tok[col < size[:, None]], size

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        tok = self.first[data].tolist()
        tok[-1] = int(self.final[data[-1]])
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(np.array(tok[:-1], np.int64), np.array(tok[1:], np.int64))
        none = len(self.pair)
        heap = [(int(x), i, tok[i], tok[i + 1]) for i, x in enumerate(ranks) if x < none]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = (tok[i], tok[j])
            if pair not in known:
                known[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] < none:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            x, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = int(self.merged[x]), -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                push(i, nxt[i])
            if prv[i] >= 0:
                push(prv[i], i)
        return np.array([t for t in tok if t >= 0], np.int64)

    def decode(self, ids) -> bytes:
        """The library's plain decoding: token strings joined by a space."""
        return b" ".join([self.tokens[i] for i in ids])


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], list[int]]:
    """Minimal acyclic automaton of sorted distinct words: arcs, final marks, words below each state.

    Words are added in order; when the next word leaves a branch, the states of
    that branch are replaced by equal ones met before, so suffixes are shared.
    """
    arcs: list[dict[int, int]] = [{}]
    final, count = [False], [0]
    register: dict[tuple, int] = {}
    path = [0]
    previous = b""

    def close(down_to: int) -> None:
        while len(path) - 1 > down_to:
            s = path.pop()
            key = (final[s], tuple(arcs[s].items()))
            same = register.get(key)
            if same is None:
                register[key] = s
                count[s] = final[s] + sum(count[t] for t in arcs[s].values())
            else:
                arcs[path[-1]][previous[len(path) - 1]] = same

    for w in words:
        k = 0
        while k < min(len(w), len(previous)) and w[k] == previous[k]:
            k += 1
        close(k)
        for c in w[k:]:
            arcs.append({})
            final.append(False)
            count.append(0)
            arcs[path[-1]][c] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        previous = w
    close(0)
    return arcs, final, count


@dataclass
class Lexicon:
    """Compiled transducer: arc table, final marks and the id pool, as one byte string."""

    blob: bytes
    sizes: tuple[int, int, int, int, int]     # table bits, arcs, states, words, ids
    _maps: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"blob": self.blob, "sizes": self.sizes, "_maps": None}

    @classmethod
    def compile(cls, words: list[bytes], tok: Tokenizer) -> Lexicon:
        words = sorted(set(words))
        arcs, final, count = minimal_automaton(words)
        number = {0: 0}                       # states still in use, renumbered
        queue = [0]
        for s in queue:
            for t in arcs[s].values():
                if t not in number:
                    number[t] = len(number)
                    queue.append(t)
        key, nxt, add = [], [], []
        for s in queue:
            below = int(final[s])             # words that come before those of an arc
            for c, t in arcs[s].items():
                key.append(number[s] << 8 | c)
                nxt.append(number[t])
                add.append(below)
                below += count[t]
        off = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        ids, at = tok.merge(np.frombuffer(b"".join(words), np.uint8), off)
        table, bits = _fill(np.array(key, np.int64))
        parts = [table, key, nxt, add, [final[s] for s in queue], at, ids]
        blob = b"".join(np.asarray(p, "<i4").tobytes() for p in parts)
        return cls(blob, (bits, len(key), len(queue), len(words), len(ids)))

    def maps(self) -> tuple:
        """The arrays, memory-mapped from a file that is unlinked at once."""
        if self._maps is None:
            bits, arcs, states, words, ids = self.sizes
            with tempfile.TemporaryFile() as f:
                f.write(self.blob)
                f.flush()
                flat = np.memmap(f, "<i4", "r")
            ends = np.cumsum([1 << bits, arcs, arcs, arcs, states, words + 1, ids])
            self._maps = tuple(np.split(flat, ends[:-1]))
        return self._maps

    def lookup(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Place of each word in the lexicon, -1 where it has none."""
        table, key, nxt, add, final, _, _ = self.maps()
        n = np.diff(off)
        state = np.zeros(len(n), np.int64)
        place = np.zeros(len(n), np.int64)
        order = np.argsort(-n, kind="stable")
        live = order[n[order] <= LONG_PIECE]
        place[n > LONG_PIECE] = -1
        for i in range(LONG_PIECE):
            live = live[:np.searchsorted(-n[live], -i, "left")]     # words with a byte i
            if not len(live):
                break
            arc = _probe(table, self.sizes[0], key, state[live] << 8 | data[off[live] + i])
            ok = arc >= 0
            place[live[~ok]] = -1
            live, arc = live[ok], arc[ok]
            state[live] = nxt[arc]
            place[live] += add[arc]
        return np.where((place >= 0) & (final[state] == 1), place, -1)


@dataclass
class Encoder:
    tok: Tokenizer
    lex: Lexicon

    def rows(self, col: pa.Array) -> Iterator[np.ndarray]:
        """Token ids of every text."""
        for segs, off, seg_row, seg_special, n in segments(col, self.tok.special):
            p = Pieces(segs, off)
            _, one, inverse = np.unique(p.hash, return_index=True, return_inverse=True)
            data, woff = p.utf8(one)
            place = self.lex.lookup(data, woff)
            at, pool = self.lex.maps()[5:]
            rare = np.flatnonzero(place < 0)
            rn = woff[rare + 1] - woff[rare]
            roff = np.concatenate([[0], np.cumsum(rn)])
            rdata = data[np.arange(roff[-1]) - np.repeat(roff[:-1], rn) + np.repeat(woff[rare], rn)]
            more, more_at = self.tok.merge(rdata, roff)
            pool = np.concatenate([pool, more])
            first = at[place]                                # place -1 is overwritten below
            size = at[place + 1] - first if len(place) else first
            first = first.astype(np.int64)
            size = size.astype(np.int64)
            first[rare] = more_at[:-1] + len(pool) - len(more)
            size[rare] = np.diff(more_at)
            m = size[inverse]
            ends = np.concatenate([[0], np.cumsum(m)])
            ids = pool[np.arange(ends[-1]) - np.repeat(ends[:-1], m) + np.repeat(first[inverse], m)].astype("<u4")
            seg_end = ends[p.row]
            if seg_special is None:
                yield from (ids[a:b] for a, b in zip(seg_end[:-1], seg_end[1:]))
                continue
            out: list[list] = [[] for _ in range(n)]
            for k, (r, s) in enumerate(zip(seg_row, seg_special)):
                out[r].append(ids[seg_end[k]:seg_end[k + 1]] if s is None else np.array([s], "<u4"))
            yield from (np.concatenate(x) if x else np.zeros(0, "<u4") for x in out)

    def digests(self, col: pa.Array) -> list:
        n, a, b = [], [], []
        for ids in self.rows(col):
            n.append(len(ids))
            a.append(hashlib.sha256(ids.tobytes()).hexdigest())
            b.append(hashlib.sha256(self.tok.decode(ids.tolist())).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]


def segments(col: pa.Array, special: dict[str, int]):
    """Chunks of texts cut at special tokens: (bytes, offsets, row of each segment, its special id, rows)."""
    data, off = buffers(col)
    split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    marks = [s.encode() for s in special]
    for i, j in chunks(off, TEXT_CHUNK):
        raw, o = data[off[i]:off[j]].tobytes(), off[i:j + 1] - off[i]
        if not any(m in raw for m in marks):
            yield raw, o, None, None, j - i
            continue
        segs, row, ids = [], [], []
        for r in range(j - i):
            for s in split.split(raw[o[r]:o[r + 1]].decode("utf-8", "replace")):
                if s:
                    segs.append(b"" if s in special else s.encode())
                    row.append(r)
                    ids.append(special.get(s))
        yield b"".join(segs), np.concatenate([[0], np.cumsum([len(s) for s in segs], dtype=np.int64)]), row, ids, j - i


def frequent_words(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS,
                   special: dict[str, int] | None = None) -> list[bytes]:
    """The words with the highest counts over all documents, at most ``words``.

    Counting is a plain sum over chunks of text; a chunk reports the pieces it
    has at least ``MIN_IN_CHUNK`` times, which only affects which words are
    looked up instead of merged, never a result.
    """
    special = special or {}

    def count(batches):
        for b in batches:
            for segs, off, *_ in segments(b.column("text"), special):
                p = Pieces(segs, off)
                _, one, n = np.unique(p.hash, return_index=True, return_counts=True)
                keep = n >= MIN_IN_CHUNK
                data, at = p.utf8(one[keep])
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:])], pa.binary()),
                    pa.array(n[keep].astype(np.int64))], names=["word", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long")
    counts = cut(counts.where(F.length("word") <= LONG_PIECE).groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = most_counted(counts, "n", words)
    return [bytes(r.word) for r in top.select("word").collect()]


def encoder(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> Encoder:
    tok = Tokenizer.load(path)
    return Encoder(tok, Lexicon.compile(frequent_words(docs, text, words, tok.special), tok))


def encode_digests(docs: DataFrame, enc: Encoder, keep: list[str], text: str = "text") -> DataFrame:
    """``(row, n_tokens, ids_sha256, decoded_sha256)``: encoded, decoded again, both hashed."""
    shared = docs.sparkSession.sparkContext.broadcast(enc)     # bounded by the tokenizer file and LEXICON_WORDS
    return annotate(docs, keep, {"text": F.col(text)}, lambda b: shared.value.digests(b.column("text")), DIGESTS)


def encode(docs: DataFrame, enc: Encoder, keep: list[str], text: str = "text") -> DataFrame:
    """``(row, ids)`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(enc)
    return annotate(docs, keep, {"text": F.col(text)},
                    lambda b: [pa.array([x.astype(np.int32) for x in shared.value.rows(b.column("text"))],
                                        pa.list_(pa.int32()))], "ids array<int>")


def decode(rows: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``(row, text)``: token strings joined by a space; null ids give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(Tokenizer.load(path))
    return annotate(rows, keep, {"ids": F.col(ids)},
                    lambda b: [pa.array([shared.value.decode(x or []).decode() for x in b.column("ids").to_pylist()],
                                        pa.string())], "text string")
