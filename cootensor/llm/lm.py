"""Language-model scoring with a log-frequency Bloom filter.

N-gram counts over all training documents are summed on Spark.  A count ``c``
is quantised to ``q = 1 + floor(log2 c)`` and the n-gram is entered in a Bloom
filter once for each level 1..q; reading a count back means probing level after
level until one is missing.  The filter is cut into segments, one per hash
bucket of n-grams; each is built by the task that has summed its bucket and has
``ENTRY_BITS`` bits for every entry, so the filter grows with the n-grams and no
count is left out.  A filter of up to ``MAX_FILTER_BYTES`` is broadcast to the
workers.  A larger one stays where it is: the distinct n-grams of each chunk of
texts are sent to the segments that know them, and their levels come back.  The
same bits are probed either way, so the scores are the same.

The model smooths towards unigrams:
``P(w | u) = (c(u, w) + MU * P1(w)) / (c(u) + MU)``,
``P1(w) = (c(w) + 1) / (N + V + 1)``, all counts read from the filter.

The add-one base score needs exact counts.  Texts are encoded once into chunks
(a sorted dictionary of word hashes and word numbers); dictionaries are sent to
the bucket that has the exact count and the counts come back to the chunk, so
no vocabulary is ever collected or broadcast.

Defined results.  Null or empty text: the end token alone.  A null id is not
held out and is learned from.  Repeated rows count and are scored row by row;
extra columns are ignored.  Without training rows every probability is 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import cut
from .text import SPACED, U64, Words, buffers, chunks, mix

MU = 8.0
MAX_FILTER_BYTES = 64 << 20    # a larger filter is not broadcast
ENTRY_BITS = 8                # filter bits per entry
LEAST_BITS = 64               # bits of a segment, at least
PROBES = 3
CHUNK_BYTES = 6 << 20         # text encoded into one chunk
SLICE = 1 << 17               # n-grams probed at once
BUCKET_BYTES = 8 << 20        # text per hash bucket
MAX_BUCKETS = 1 << 16
RESULTS = "n_tokens long, n_known long, train_tokens long, base_score double, score double"

END, BEGIN = U64(0xE0D0E0D0E0D0E0D1), U64(0xB0E0B0E0B0E0B0E1)


def _zip(a: np.ndarray) -> bytes:
    """Compressed numbers, the bytes of equal weight side by side: the high ones are mostly zero."""
    return pa.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), "zstd", asbytes=True) if a.size else b""


def _unzip(b: bytes, kind: str, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b, n * size, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _zip_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned numbers by their gaps."""
    return _zip(np.diff(a, prepend=a.dtype.type(0)))


def _unzip_sorted(b: bytes, kind: str, n: int) -> np.ndarray:
    gaps = _unzip(b, kind, n)
    return np.cumsum(gaps, dtype=gaps.dtype)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _split(sorted_hash: np.ndarray, buckets: int):
    """(bucket, from, to) of the non-empty buckets of sorted hashes."""
    b = _bucket(sorted_hash, buckets)
    at = np.flatnonzero(np.diff(b, prepend=-1))
    yield from zip(b[at].tolist(), at.tolist(), np.append(at[1:], len(b)).tolist())


def bigrams(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it (the begin mark at a text's start)."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.concatenate([[0], ends[:-1]])] = BEGIN
    return mix(before * U64(0x9E3779B97F4A7C15) + (words ^ U64(0xD1B54A32D192ED03)))


_CHUNK_SCHEMA = "chunk long, n_words long, n_tokens long, words binary, numbers binary, tokens binary, ends binary, trained binary"


def encode(docs: DataFrame, keep: list[str], held_out: Column, text: str = "text") -> DataFrame:
    """Chunks of documents as word numbers: their kept rows, dictionary, tokens, text ends and training flags."""
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], held_out.alias("held_out")).alias("row"),
                      F.col(text).alias("text"), held_out.alias("held"))
    out = T.StructType([T.StructField("rows", T.ArrayType(src.schema["row"].dataType)),
                        *T._parse_datatype_string(_CHUNK_SCHEMA).fields])
    names = out.names

    def run(batches):
        task, count = TaskContext.get().partitionId() << 24, 0
        rows, held, hashes, sizes, held_bytes = [], [], [], [], 0

        def flush():
            nonlocal count
            h = np.concatenate(hashes)
            words, ids = np.unique(h, return_inverse=True)
            n = np.concatenate(sizes)
            table = pa.concat_arrays(rows)
            rank = np.argsort(np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable"))
            order = np.argsort(rank).astype("<u4")      # word of each rank: frequent words get small numbers, which pack well
            packed = (len(words), len(ids), _zip_sorted(words), _zip(order), _zip(rank[ids].astype("<u4")),
                      _zip(np.cumsum(n).astype("<u4")), np.concatenate(held).astype(np.uint8).tobytes())
            count += 1
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table),
                 pa.array([task + count], pa.int64()), *[pa.array([x]) for x in packed]], names=names)

        for b in batches:
            data, off = buffers(b.column("text"))
            flags = np.asarray(b.column("held").to_numpy(zero_copy_only=False), bool)
            for i, j in chunks(off):
                w = Words(data[off[i]:off[j]], off[i:j + 1] - off[i], SPACED)
                at = w.row[1:] + np.arange(j - i)                    # each text gets its end token
                h = np.insert(w.hash, w.row[1:], END)
                rows.append(b.column("row").slice(i, j - i))
                hashes.append(h)
                sizes.append(np.diff(at, prepend=-1))      # tokens of each text
                held.append(~flags[i:j])
                held_bytes += int(off[j] - off[i])
                if held_bytes >= CHUNK_BYTES:
                    yield flush()
                    rows, held, hashes, sizes, held_bytes = [], [], [], [], 0
        if rows:
            yield flush()

    return src.mapInArrow(run, out)


class Chunk:
    """One encoded chunk, unpacked."""

    def __init__(self, b: pa.RecordBatch, i: int):
        get = lambda name: b.column(name)[i].as_py()
        v, n = get("n_words"), get("n_tokens")
        self.id = get("chunk")
        self.words = _unzip_sorted(get("words"), "<u8", v)
        self.ids = _unzip(get("numbers"), "<u4", v)[_unzip(get("tokens"), "<u4", n)]   # into words
        trained = get("trained")
        self.ends = _unzip(get("ends"), "<u4", len(trained)).astype(np.int64)
        self.trained = np.frombuffer(trained, np.uint8).astype(bool)
        self.learn = np.repeat(self.trained, np.diff(self.ends, prepend=0))


def _vocabulary(batches, buckets: int):
    for b in batches:
        for i in range(b.num_rows):
            c = Chunk(b, i)
            n = np.bincount(c.ids[c.learn], minlength=len(c.words)).astype("<u4")
            parts = [(c.id, k, y - x, _zip_sorted(c.words[x:y]), _zip(n[x:y])) for k, x, y in _split(c.words, buckets)]
            yield pa.RecordBatch.from_pylist([dict(zip(("chunk", "bucket", "n", "words", "counts"), p)) for p in parts],
                                             pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()),
                                                        ("words", pa.binary()), ("counts", pa.binary())]))


def _exact_counts(t: pa.Table) -> pa.Table:
    """One bucket: sum the counts of each word, and send them back to every chunk that has it."""
    sizes = t["n"].to_numpy()
    words = np.concatenate([_unzip_sorted(x.as_py(), "<u8", n) for x, n in zip(t["words"], sizes)])
    counts = np.concatenate([_unzip(x.as_py(), "<u4", n) for x, n in zip(t["counts"], sizes)])
    distinct, inverse = np.unique(words, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, counts)
    back = np.split(total[inverse], np.cumsum(sizes)[:-1])
    n = len(sizes)
    stats = np.zeros((2, n), np.int64)
    stats[:, 0] = total.sum(), (total > 0).sum()
    return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "n": t["n"],
                     "counts": pa.array([_zip(x.astype("<u8")) for x in back], pa.binary()),
                     "tokens": stats[0], "types": stats[1]})


def _grams(batches, buckets: int):
    """Distinct n-grams (words, and word pairs) of the training texts of each chunk, with counts."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    for b in batches:
        for i in range(b.num_rows):
            c = Chunk(b, i)
            w = c.words[c.ids]
            both = np.concatenate([w[c.learn], bigrams(w, c.ends)[c.learn]]) if len(w) else w
            h, n = np.unique(both, return_counts=True)
            parts = []
            for k, x, y in _split(h, buckets):
                key = h[x:y].astype("<u4")                      # the low half: the bucket tells the high one
                order = np.argsort(key, kind="stable")
                parts.append((k, y - x, _zip_sorted(key[order]), _zip(n[x:y][order].astype("<u4"))))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, p)) for p in parts], schema)


def _places(key: np.ndarray, bucket, level: int, bits):
    """Bit places of (n-gram, level) inside its bucket's segment, one array per probe, made when asked for."""
    bits = np.broadcast_to(np.asarray(bits, U64), key.shape)
    x = mix(mix(key.astype(U64) | (np.asarray(bucket, U64) << U64(32))) + U64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    a, b = x >> U64(32), (x & U64(0xFFFFFFFF)) | U64(1)
    return (lambda k, at=slice(None): ((a[at] + U64(k) * b[at]) % bits[at]).astype(np.int64))


def _levels(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def _segment(t: pa.Table, bits: int | None = None, entry_bits: int = ENTRY_BITS) -> pa.Table:
    """One bucket's counts as a filter segment of ``bits`` bits (``entry_bits`` for every entry)."""
    sizes = t["n"].to_numpy()
    keys = np.concatenate([_unzip_sorted(x.as_py(), "<u4", n) for x, n in zip(t["keys"], sizes)])
    counts = np.concatenate([_unzip(x.as_py(), "<u4", n) for x, n in zip(t["counts"], sizes)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
    keys, counts = keys[at], np.add.reduceat(counts.astype(np.int64), at)
    q = _levels(counts)
    bits = bits or max(LEAST_BITS, -(-int(q.sum()) * entry_bits // 8) * 8)
    seg = np.zeros(bits, bool)
    bucket = t["bucket"][0].as_py()
    for level in range(1, int(q.max()) + 1 if len(q) else 1):
        place = _places(keys[q >= level], bucket, level, bits)
        for k in range(PROBES):
            seg[place(k)] = True
    return pa.table({"bucket": [bucket], "segment": pa.array([np.packbits(seg, bitorder="little").tobytes()], pa.binary())})


class CountFilter:
    """Filter segments side by side: quantised counts by repeated membership probes."""

    def __init__(self, segments: dict[int, bytes], buckets: int, least_bits: int = LEAST_BITS):
        self.buckets = buckets
        empty = bytes(least_bits // 8)
        held = [segments.get(b, empty) for b in range(buckets)]
        self.bits = np.array([len(x) * 8 for x in held], np.int64)
        self.base = np.cumsum(self.bits) - self.bits
        self.data = b"".join(held)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Count of each n-gram as its level tells it (0 where absent)."""
        return told(self.levels(h))

    def levels(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([self._levels(h[i:i + SLICE]) for i in range(0, len(h), SLICE)] or [np.zeros(0, np.int64)])

    def _levels(self, h: np.ndarray) -> np.ndarray:
        bucket = _bucket(h, self.buckets)
        return probe(np.frombuffer(self.data, np.uint8), h & U64(0xFFFFFFFF), bucket, self.bits[bucket], self.base[bucket])


def told(q: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of its counts."""
    return np.where(q > 1, 1.5 * 2.0 ** (q - 1), q)


def probe(data: np.ndarray, key: np.ndarray, bucket: np.ndarray, bits: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Highest level up to which each n-gram is a member of its segment (``bits`` from bit ``base`` of ``data`` on)."""
    q = np.zeros(len(key), np.int64)
    live, level = np.arange(len(key)), 1
    while len(live) and level < 64:
        place = _places(key[live], bucket[live], level, bits[live])
        in_it = np.arange(len(live))
        for k in range(PROBES):
            at = base[live[in_it]] + place(k, in_it)
            in_it = in_it[(data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        live = live[in_it]
        q[live] = level
        level += 1
    return q


def _asked(c: Chunk) -> np.ndarray:
    """The distinct n-grams a chunk's scores need, in the order of their hashes."""
    return np.unique(np.concatenate([c.words, bigrams(c.words[c.ids], c.ends), np.array([END])]))


def _questions(batches, buckets: int):
    """The n-grams of each chunk, by bucket."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])
    for b in batches:
        for i in range(b.num_rows):
            c = Chunk(b, i)
            h = _asked(c)
            parts = [(c.id, k, y - x, _zip_sorted(h[x:y])) for k, x, y in _split(h, buckets)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, p)) for p in parts], schema)


def _answers(asked: pa.Table, segment: pa.Table) -> pa.Table:
    """One bucket: the levels of the n-grams asked for."""
    out = []
    data = np.frombuffer(segment["segment"][0].as_py() if segment.num_rows else bytes(LEAST_BITS // 8), np.uint8)
    for k, n, keys in zip(asked["bucket"].to_pylist(), asked["n"].to_pylist(), asked["keys"]):
        h = _unzip_sorted(keys.as_py(), "<u8", n)
        q = probe(data, h & U64(0xFFFFFFFF), np.full(n, k), np.full(n, 8 * len(data)), np.zeros(n, np.int64))
        out.append(_zip(q.astype(np.uint8)))
    return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "n": asked["n"], "levels": pa.array(out, pa.binary())})


class Answers:
    """Counts of a chunk's n-grams from the levels that came back."""

    def __init__(self, c: Chunk, answers: list):
        self.asked = _asked(c)
        got = sorted(answers, key=lambda x: x["bucket"])
        self.levels = np.concatenate([_unzip(x["levels"], "u1", x["n"]) for x in got]).astype(np.int64)

    def counts(self, h: np.ndarray) -> np.ndarray:
        return told(self.levels[np.searchsorted(self.asked, h)])


def _score(batches, model, n_train: int, types: int, names: list[str]):
    flt = model.value if model else None
    total = n_train + types + 1
    for b in batches:
        for i in range(b.num_rows):
            c = Chunk(b, i)
            back = sorted(b.column("back")[i].as_py(), key=lambda x: x["bucket"])
            exact = np.concatenate([_unzip(x["counts"], "<u8", x["n"]) for x in back]).astype(np.int64)
            base = np.log10((exact + 1) / total)[c.ids]
            known = (exact > 0)[c.ids]
            if model is None:
                flt = Answers(c, b.column("answers")[i].as_py())
            uni = flt.counts(c.words)
            p1 = np.minimum(1.0, (uni + 1) / total)
            w = c.words[c.ids]
            context = np.empty(len(w))
            context[1:] = uni[c.ids][:-1]
            context[np.concatenate([[0], c.ends[:-1]])] = flt.counts(np.array([END]))[0]   # as many begins as ends
            pair = np.minimum(flt.counts(bigrams(w, c.ends)), context)
            p = np.log10((pair + MU * p1[c.ids]) / (context + MU))
            first = np.concatenate([[0], c.ends[:-1]])
            rows = b.column("rows")[i].values
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(np.diff(c.ends, prepend=0)), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                 pa.array(np.full(len(first), n_train)), pa.array(np.add.reduceat(base, first)),
                 pa.array(np.minimum(0.0, np.add.reduceat(p, first)))], names=names)


def score(docs: DataFrame, keep: list[str], held_out: Column, text: str = "text",
          max_filter_bytes: int = MAX_FILTER_BYTES, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """``(row, n_tokens, n_known, train_tokens, base_score, score)``; ``row`` has the kept columns and ``held_out``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, max(16, -(-size // BUCKET_BYTES))))
    enc = cut(encode(docs, keep, held_out, text), "lm-chunks")
    vocab = enc.drop("rows").mapInArrow(lambda it: _vocabulary(it, buckets),
                                        "chunk long, bucket long, n long, words binary, counts binary")
    counts = cut(vocab.groupBy("bucket").applyInArrow(
        _exact_counts, "chunk long, bucket long, n long, counts binary, tokens long, types long"), "lm-counts")
    n_train, types = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()

    segments = cut(enc.drop("rows").mapInArrow(lambda it: _grams(it, buckets), "bucket long, n long, keys binary, counts binary")
                   .groupBy("bucket").applyInArrow(lambda t: _segment(t, None, entry_bits), "bucket long, segment binary"), "lm-filter")
    back = counts.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "counts")).alias("back"))
    joined = enc.join(back, "chunk")
    held = segments.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    shared = None
    if held <= max_filter_bytes:
        model = CountFilter({r.bucket: bytes(r.segment) for r in segments.toLocalIterator()}, buckets)
        shared = spark.sparkContext.broadcast(model)          # at most max_filter_bytes
    else:
        asked = enc.drop("rows").mapInArrow(lambda it: _questions(it, buckets), "chunk long, bucket long, n long, keys binary")
        answers = asked.groupBy("bucket").cogroup(segments.groupBy("bucket")) \
            .applyInArrow(_answers, "chunk long, bucket long, n long, levels binary")
        joined = joined.join(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "levels")).alias("answers")), "chunk")

    out = T.StructType([T.StructField("row", enc.schema["rows"].dataType.elementType),
                        *T._parse_datatype_string(RESULTS).fields])
    names = out.names
    return joined.mapInArrow(lambda it: _score(it, shared, n_train, types, names), out)
