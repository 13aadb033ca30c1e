"""Substring dedup by MinHash banding of anchored paragraphs.

Repeated passages need not respect line breaks, so paragraphs are cut by
content: every word that ``SPAN`` words can start from has the hash of its word
pair, an anchor is the smallest of ``SPREAD`` neighbours, and a paragraph is the
``SPAN`` words from an anchor on.  ``SURE`` = ``SPAN + SPREAD - 1`` = 26 shared words
in a row hold ``SPREAD`` such places, whose smallest is an anchor in both texts: a
passage of 26 words or more is found wherever it stands, whatever is around it.
Texts of fewer words are one paragraph, whole.

Paragraphs with the same shingles are one class.  The others meet through bands
of min-hashes: ``BANDS`` bands of ``ROWS`` rows find a pair of Jaccard similarity
0.75 with probability 1 - (1 - 0.75^ROWS)^BANDS = 0.96.  All classes of a band
are joined by exact Jaccard similarity, and components of the links are clusters.
A cluster that spans several documents is removed everywhere but in the document
with the smallest id.

Paragraphs travel packed per hash bucket.  Classes of one text that share a band
are joined where the text is read; only bands that hold several texts are sent the
shingles of their classes.  The join of a band compares classes that share one of
their rarest shingles; a long list of those is worked off from leaders, since a
class further than twice the distance from a leader links to none of its links.
A band of over ``BLOCK`` classes is joined by pairs of blocks.

Defined results.  Null or empty text and texts under ``K`` words have no
paragraph.  A passage repeated in one document only is left alone.  Rows with a
null id take part but name no document; repeated ids count as one document.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, pair_components
from .bloom import in_filter, key_filter
from .text import SPACED, U64, Words, buffers, chunks, mix, ngram_hash

K = 5                     # words of a shingle
THRESHOLD = 75            # per cent of shingles in common
SPREAD = 11               # places an anchor is the smallest of
SPAN = 16                 # words of a paragraph
SURE = SPAN + SPREAD - 1  # words in a row that hold an anchored paragraph
WIDTH = SURE - K          # shingles of a paragraph, at most: a text of SURE - 1 words
BANDS, ROWS = 4, 2
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 1 << 16
HELD = 1 << 18            # paragraphs a task gathers before it sends them
BLOCK = 1 << 15           # classes of one band joined by one task
LIST = 16                 # classes of one band, or with a rare shingle in common, that are compared pair by pair

_PERM = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(77)) | U64(1)


def _anchors(words: Words) -> np.ndarray:
    """Word numbers of the anchors: the smallest word pair of every ``SPREAD`` places of one text (the last of equal ones)."""
    h = mix(ngram_hash(words.hash, 2))
    last = np.repeat(words.row[1:], np.diff(words.row))               # first word after the row
    start = np.flatnonzero(last - np.arange(len(last)) >= SURE)       # words that SURE words of one text start from
    if not len(start):
        return start
    back = np.lib.stride_tricks.sliding_window_view(h, SPREAD)[:, ::-1]
    pick = np.empty(len(start), np.int64)
    for i in range(0, len(start), 1 << 15):
        part = start[i:i + (1 << 15)]
        pick[i:i + len(part)] = part + SPREAD - 1 - back[part].argmin(1)
    return np.unique(pick)


def _overlap(s: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in common and in all of the set pairs (rows of ``s``, distinct shingles first)."""
    both = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 1 << 13):
        x, y = s[a[i:i + (1 << 13)]], s[b[i:i + (1 << 13)]]
        inside = np.arange(s.shape[1]) < size[a[i:i + (1 << 13)]][:, None]
        other = np.arange(s.shape[1]) < size[b[i:i + (1 << 13)]][:, None]
        same = np.zeros(x.shape, bool)
        for k in range(s.shape[1]):
            same |= (x == y[:, k:k + 1]) & other[:, k:k + 1]
        both[i:i + (1 << 13)] = (same & inside).sum(1)
    return both, size[a] + size[b] - both


def links(group: np.ndarray, s: np.ndarray, size: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group with the similarity, enough of them to connect all that are linked.

    Rows of a group are neighbours; row i of ``s`` starts with ``size[i]`` distinct shingles.
    """
    out = [np.zeros((0, 2), np.int64)]

    def all_pairs(at: np.ndarray, n: np.ndarray, held=None) -> None:
        for length in np.unique(n[(n > 1) & (n <= LIST)]):
            i, j = np.triu_indices(length, 1)
            x = at[n == length][:, None] + np.arange(length)
            x = x if held is None else held[x]
            out.append(np.stack([x[:, i].ravel(), x[:, j].ravel()], 1))

    at = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)])
    n = np.diff(np.append(at, len(group)))
    all_pairs(at, n)
    large = np.repeat(n > LIST, n)
    row, col = np.nonzero((np.arange(s.shape[1]) < size[:, None]) & large[:, None])
    token, inverse, often = np.unique(mix(group[row] * U64(0x9E3779B97F4A7C15) + s[row, col]), return_inverse=True, return_counts=True)
    order = np.lexsort((inverse, often[inverse], row))               # a row's rarest shingles first
    row, inverse = row[order], inverse[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    prefix = size - -(-threshold * size // 100) + 1                  # linked sets share one of these
    ok = (rank < prefix[row]) & (often[inverse] > 1)
    row, inverse = row[ok], inverse[ok]
    order = np.lexsort((row, inverse))
    row, inverse = row[order], inverse[order]
    at = np.flatnonzero(np.diff(inverse, prepend=-1))
    n = np.diff(np.append(at, len(row)))
    all_pairs(at, n, row)
    pairs = np.concatenate(out)
    if len(row):
        pairs = np.unique(pairs, axis=0)
    both, total = _overlap(s, size, pairs[:, 0], pairs[:, 1])
    found = [pairs[100 * both >= threshold * total]]
    for x, length in zip(at[n > LIST], n[n > LIST]):
        left = row[x:x + length]
        while len(left) > 1:
            lead, rest = left[0], left[1:]
            both, total = _overlap(s, size, np.full(len(rest), lead), rest)
            linked = 100 * both >= threshold * total
            # distances obey the triangle inequality: only these can link to one that the leader links to
            ring = rest[~linked & (100 * both >= (2 * threshold - 100) * total)]
            near = rest[linked]
            found.append(np.stack([np.full(len(near), lead), near], 1))
            for i in range(0, len(ring), 1 << 10):
                part = ring[i:i + (1 << 10)]
                for j in range(0, len(near), 1 << 10):
                    b = near[j:j + (1 << 10)]
                    p, q = np.repeat(part, len(b)), np.tile(b, len(part))
                    both, total = _overlap(s, size, p, q)
                    yes = 100 * both >= threshold * total
                    found.append(np.stack([p[yes], q[yes]], 1))
            left = rest[~linked]
    found = np.concatenate(found)
    return found[:, 0], found[:, 1]


class Paragraphs:
    """Paragraphs of a chunk of texts: row, first and last word, class, shingles."""

    def __init__(self, words: Words):
        n = np.diff(words.row)
        at = _anchors(words)
        row = np.searchsorted(words.row, at, "right") - 1
        g = ngram_hash(words.hash, K)
        short = np.flatnonzero((n >= K) & (n < SURE))
        first = words.row[:-1][short]
        self.row = np.concatenate([row, short])
        self.first = np.concatenate([at, first])
        self.last = np.concatenate([at + SPAN - 1, first + n[short] - 1])
        width = WIDTH if len(short) else SPAN - K + 1
        idx = self.first[:, None] + np.arange(width)
        inside = idx <= (self.last - K + 1)[:, None]
        self.shingles = g[np.minimum(idx, max(0, len(g) - 1))] if len(g) else np.zeros(idx.shape, U64)
        self.inside = inside
        s = np.where(inside, mix(self.shingles), U64(0))
        self.sig = mix(s.sum(1, dtype=U64) + inside.sum(1).astype(U64))

    def sets(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of paragraphs, the first ``size`` of each row."""
        s, inside = self.shingles[which], self.inside[which].copy()
        order = np.lexsort((s, ~inside), axis=1)
        s, inside = np.take_along_axis(s, order, 1), np.take_along_axis(inside, order, 1)
        inside[:, 1:] &= s[:, 1:] != s[:, :-1]
        order = np.argsort(~inside, axis=1, kind="stable")
        return np.take_along_axis(s, order, 1), inside.sum(1)

    def own_links(self, which: np.ndarray, keys: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked classes among the paragraphs of one text that share a band."""
        if not len(which):
            return self.sig[:0], self.sig[:0]
        at = np.tile(np.arange(len(which))[:, None], (1, keys.shape[1])).ravel()
        group = mix(keys.ravel() + mix(self.row[which][at].astype(U64)))
        order = np.argsort(group, kind="stable")
        at, group = at[order], group[order]
        same = group[1:] == group[:-1]
        held = np.append(same, False) | np.append(False, same)
        at, group = at[held], group[held]
        some, back = np.unique(at, return_inverse=True)
        s, size = self.sets(which[some])
        a, b = links(group, s[back], size[back], threshold)
        a, b = self.sig[which[at[a]]], self.sig[which[at[b]]]
        return a[a != b], b[a != b]

    def band_keys(self, which: np.ndarray) -> np.ndarray:
        """Paragraphs x bands."""
        s, inside = self.shingles[which], self.inside[which]
        full = inside.all()
        keys = np.zeros((len(which), BANDS), U64)
        for b in range(BANDS):
            key = np.full(len(which), b + 1, U64)
            for r in range(ROWS):
                m = s * _PERM[b * ROWS + r]
                if not full:
                    m = np.where(inside, m, U64(0xFFFFFFFFFFFFFFFF))
                key = mix(key + m.min(1))
            keys[:, b] = key
        return keys


def _chunks(col: pa.Array):
    data, off = buffers(col)
    for i, j in chunks(off):
        o = off[i:j + 1] - off[i]
        words = Words(data[off[i]:off[j]], o, SPACED)
        yield i, j, words, Paragraphs(words)


def _place(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _packed(h: np.ndarray, value: np.ndarray, doc: np.ndarray, buckets: int, shift: int):
    """Rows (bucket, keys, values, documents) of hashes with 8-byte values."""
    place = _place(h, buckets)
    order = np.argsort(place, kind="stable")
    place, h, value, doc = place[order], h[order], value[order], doc[order]
    at = np.flatnonzero(np.diff(place, prepend=-1))
    ends = np.append(at[1:], len(h))
    low = (h & U64(0xFFFFFFFF)).astype("<u4")
    return pa.RecordBatch.from_arrays([
        pa.array(place[at] + shift), pa.array([low[x:y].tobytes() for x, y in zip(at, ends)], pa.binary()),
        pa.array([value[x:y].astype("<u8").tobytes() for x, y in zip(at, ends)], pa.binary()),
        pa.array([doc[x:y].astype("<u4").tobytes() for x, y in zip(at, ends)], pa.binary())], names=["bucket", "keys", "vals", "docs"])


def _send(batches, buckets: int, threshold: int):
    """Classes with their document counts (buckets from 0), their band keys (from ``buckets`` on), links inside texts (below 0)."""
    sigs, bands, own, held = [], [], [], 0
    seen = TaskContext.get().partitionId() << 40

    def flush():
        s, n = np.unique(np.concatenate(sigs), return_counts=True)
        yield _packed(s, (s & U64(0xFFFFFFFF00000000)) | n.astype(U64), np.zeros(len(s), np.int64), buckets, 0)
        s, keys, doc = (np.concatenate(x) for x in zip(*bands))
        _, one, n = np.unique(s, return_index=True, return_counts=True)
        doc = np.where(n > 1, U64(0), doc[one])                  # 0: in several texts
        yield _packed(keys[one].ravel(), np.repeat(s[one], BANDS), np.repeat(doc, BANDS), buckets, buckets)
        a, b = (np.concatenate(x) for x in zip(*own))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array([-1 - TaskContext.get().partitionId() % buckets], pa.int64()), pa.array([a.tobytes()], pa.binary()),
                                              pa.array([b.tobytes()], pa.binary()), pa.array([b""], pa.binary())],
                                             names=["bucket", "keys", "vals", "docs"])

    for b in batches:
        for i, j, _, p in _chunks(b.column("text")):
            # each class once per text
            order = np.lexsort((p.sig, p.row))
            once = order[np.append(True, (np.diff(p.row[order]) != 0) | (p.sig[order][1:] != p.sig[order][:-1]))[:len(order)]]
            keys = p.band_keys(once)
            sigs.append(p.sig[once])
            bands.append((p.sig[once], keys, (mix((p.row[once] + seen).astype(U64)) >> U64(32)) | U64(1)))
            own.append(p.own_links(once, keys, threshold))
            held += len(once)
            seen += j - i
            if held >= HELD:
                yield from flush()
                sigs, bands, own, held = [], [], [], 0
    if held:
        yield from flush()


def _meet(t: pa.Table, buckets: int, block: int) -> pa.Table:
    """One bucket: classes of several texts (kind 0), links inside texts (1), or (band, class) of bands that hold several texts (2)."""
    kind = t["bucket"][0].as_py()
    if kind < 0:
        a, b = (np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in t[c]]) for c in ("keys", "vals"))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).view(np.int64)
        return pa.table({"kind": np.full(len(pairs), 1, np.int32), "a": pairs[:, 0], "b": pairs[:, 1]})
    key = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in t["keys"]])
    val = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in t["vals"]])
    if kind < buckets:
        sig = (val & U64(0xFFFFFFFF00000000)) | key
        order = np.argsort(sig, kind="stable")
        sig, n = sig[order], (val & U64(0xFFFFFFFF))[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        n = np.add.reduceat(n, at)
        a = sig[at][n > 1].view(np.int64)
        return pa.table({"kind": np.zeros(len(a), np.int32), "a": a, "b": a})
    doc = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in t["docs"]])
    order = np.lexsort((doc, val, key))
    key, val, doc = key[order], val[order], doc[order]
    one = np.append(True, (key[1:] != key[:-1]) | (val[1:] != val[:-1]))
    first = np.flatnonzero(one)
    last = np.append(first[1:], len(key)) - 1
    doc = np.where(doc[first] == doc[last], doc[first], 0)           # 0: in several texts
    key, val = key[first], val[first]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(at, len(key)))
    low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
    ok = (n > 1) & ((low != high) | (low == 0))                      # classes of one text alone are joined already
    # a band is named by its classes: bands that hold the same ones are one
    name = mix(np.add.reduceat(mix(val), at) + n.astype(U64))
    rest = np.repeat(ok & (n <= block), n)
    out_a, out_b = [np.repeat(name, n)[rest]], [val[rest]]
    for x, size, g in zip(at[ok & (n > block)], n[ok & (n > block)], name[ok & (n > block)]):
        parts = -(-int(size) // (block // 2))
        for p in range(parts):
            for q in range(p + 1, parts):
                both = np.concatenate([val[x + p:x + size:parts], val[x + q:x + size:parts]])
                out_a.append(np.full(len(both), mix(np.array([g + U64(p * parts + q + 1)]))[0]))
                out_b.append(both)
    a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
    return pa.table({"kind": np.full(len(a), 2, np.int32), "a": a, "b": b})


def _join(batches, threshold: int):
    """Links of rows (group, sig, set) in the order of the groups."""
    def flush(parts):
        t = pa.Table.from_batches(parts)
        group, sig = t["group"].to_numpy().view(U64), t["sig"].to_numpy()
        raw = [x.as_py() for x in t["set"]]
        size = np.array([len(x) // 8 for x in raw], np.int64)
        s = np.zeros((len(raw), WIDTH), U64)
        s[np.arange(s.shape[1]) < size[:, None]] = np.frombuffer(b"".join(raw), U64)
        a, b = links(group, s, size, threshold)
        pairs = np.unique(np.stack([np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b])], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            group = b.column("group").to_numpy()
            end = int(np.searchsorted(group, group[-1]))     # the last group may go on
            if end or (len(held) > 1 and held[-2].column("group")[-1].as_py() != group[0]):
                yield flush([*held[:-1], b.slice(0, end)])
                held, n = [b.slice(end)], b.num_rows - end
    if n:
        yield flush(held)


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD,
               block: int = BLOCK) -> DataFrame:
    """``(doc_id, first_doc_id, start, end, removed)``: every stretch of a text that other documents share.

    ``start`` and ``end`` are code points (end exclusive); ``first_doc_id`` is the
    smallest id with the passage; all other documents' stretches are removed.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, max(8, -(-size // BUCKET_BYTES))))
    src = docs.select(F.col(text).alias("text"))
    met = cut(src.mapInArrow(lambda it: _send(it, buckets, threshold), "bucket long, keys binary, vals binary, docs binary")
              .groupBy("bucket").applyInArrow(lambda t: _meet(t, buckets, block), "kind int, a long, b long").distinct(), "met")
    repeated = met.where("kind = 0").select(F.col("a").alias("sig"))
    bands = met.where("kind = 2").select(F.col("a").alias("group"), F.col("b").alias("sig"))

    # exact Jaccard similarity of the colliding classes
    asked = key_filter(bands, "sig")

    def shingles(batches):
        table = asked.value
        for b in batches:
            for _, _, _, p in _chunks(b.column("text")):
                sig, one = np.unique(p.sig, return_index=True)
                ok = in_filter(table, sig)
                s, size = p.sets(one[ok])
                yield pa.RecordBatch.from_arrays([
                    pa.array(sig[ok].view(np.int64)),
                    pa.array([x[:n].tobytes() for x, n in zip(s, size)], pa.binary())], names=["sig", "set"])

    sets = src.mapInArrow(shingles, "sig long, set binary").groupBy("sig").agg(F.first("set").alias("set"))
    met_again = bands.join(sets, "sig").select("group", "sig", "set").repartition("group").sortWithinPartitions("group") \
        .mapInArrow(lambda it: _join(it, threshold), "a long, b long")
    near = pair_components(met_again.unionByName(met.where("kind = 1").select("a", "b")))
    classes = cut(repeated.join(near, repeated.sig == near.node, "full")
                  .select(F.coalesce("sig", "node").alias("sig"), F.coalesce("component", "sig").alias("cluster")), "classes")

    # where the classes stand
    wanted = key_filter(classes, "sig")
    spots = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = spots.schema["id"].dataType.simpleString()

    def stand(batches):
        table = wanted.value
        rows = TaskContext.get().partitionId() << 40
        for b in batches:
            ids = b.column("id")
            for i, j, words, p in _chunks(b.column("text")):
                at = np.flatnonzero(in_filter(table, p.sig))
                lead = np.concatenate([[0], np.cumsum((words.buf & 0xC0) != 0x80)])
                if len(at):
                    base = words.offsets[p.row[at]]
                    start = lead[words.start[p.first[at]]] - lead[base]
                    end = lead[words.end[p.last[at]]] - lead[base]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows + p.row[at]), ids.take(pa.array(i + p.row[at])), pa.array(p.sig[at].view(np.int64)),
                        pa.array(start), pa.array(end)], names=["rk", "id", "sig", "start", "end"])
                rows += j - i

    found = spots.mapInArrow(stand, f"rk long, id {id_type}, sig long, start long, end long").join(classes, "sig")
    found = cut(found.select("rk", "id", "cluster", "start", "end"), "spots")
    shared = found.groupBy("cluster").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last"))
    held = found.join(shared.select("cluster", "first"), "cluster")
    order = Window.partitionBy("rk", "first").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))) \
        .withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy("rk", "first", "part").agg(F.first("id").alias(doc_id), F.min("start").alias("start"), F.max("end").alias("end")) \
        .select(doc_id, F.col("first").alias("first_doc_id"), "start", "end",
                (~F.col(doc_id).eqNullSafe(F.col("first"))).alias("removed"))
