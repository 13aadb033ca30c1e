"""Exact n-gram Jaccard join of documents with set-relation skipping.

A document's set is its distinct k-word shingles; documents link when
``100 * intersection >= T * union``.  Equal sets form one node, so copies are
never paired.  The answers wanted are each document's links as a component.

1. Nodes that agree in two of a few min-hashes are paired with one leader per
   min-hash (linear in the nodes) and verified: highly similar sets get one
   computed answer, their component.
2. Every node enters its prefix (the first quarter of its set, rare shingles
   first) into index lists.  A list is kept in blocks by component: pairs inside a
   block are skipped, as their answer is known.  Between blocks the sizes and
   the positions of a shared shingle decide what is skipped: sets of sizes n and m
   that overlap in ``o`` share ``L`` shingles among the first n - o + L and m - o + L,
   so later positions are passed over, and pairs that share fewer are dropped.
3. A candidate pair of members is first answered from its leaders' pair: Jaccard
   distance is a metric, so a pair whose leaders are too far apart cannot link,
   and a pair whose leaders link needs no check.  The rest is verified exactly.

The order of shingles only steers the cost: shingles seen often are put last, by
a table of at most ``ORDER_SHINGLES`` entries.  No step pairs all members of a
group, and sets of documents never reach the driver.

Defined results.  Null or empty text, or text without words: an empty set, size
0, linked with nothing, component = its own id.  Fewer than k words: one shingle,
the whole word sequence.  Repeated ids: rows are kept, the smallest id of the
component is reported; null ids never name a component unless all are null.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import in_filter, key_filter
from .frames import cut, most_counted, pair_components
from .text import SPACED, U64, Words, buffers, chunks, mix, shingle_sets

K = 5
THRESHOLD = 75                     # per cent
MINHASHES = 8
AGREE = 2                          # min-hashes a node shares with a leader to be paired with it
ORDER_SHINGLES = 1 << 18           # most frequent shingles put last in the order
WINDOW_SHINGLES = 1 << 21          # shingles a task counts at once for that
SEEN = 3                           # a count window reports what it has in so many documents
EXTEND = 128                       # prefixes are longer by a share of 1 / EXTEND, and must share as many shingles more
BUCKET_BYTES = 8 << 20             # text per index bucket
MAX_BUCKETS = 1 << 16
PAIR_BLOCK = 1 << 18               # pairs expanded at once inside a list

_PERM = mix(np.arange(1, MINHASHES + 1, dtype=U64)) | U64(1)


def _signature(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    x = mix(s).sum(dtype=U64, keepdims=True)
    return int(mix(x + np.array([len(s)], U64) * U64(0x9E3779B97F4A7C15))[0].view(np.int64))


def _sets(col: pa.Array, k: int):
    data, off = buffers(col)
    for i, j in chunks(off):
        yield from shingle_sets(Words(data[off[i]:off[j]], off[i:j + 1] - off[i], SPACED), k)


def describe(docs: DataFrame, keep: list[str], text: str = "text", k: int = K) -> DataFrame:
    """Set size, identity and min-hashes per document; and rows (size -1) of shingles seen often.

    A task counts the documents of each shingle over windows of
    ``WINDOW_SHINGLES`` shingles; those in ``SEEN`` or more are reported.
    """
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                      F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    extra = T._parse_datatype_string("n long, fp long, mins array<long>, often binary, times binary")
    out = T.StructType([T.StructField("row", src.schema["row"].dataType), src.schema["th"], *extra.fields])
    names, kind = out.names, pa.list_(pa.int64())

    def run(batches):
        window, held, row_type = [], 0, None

        def seen():
            s, c = np.unique(np.concatenate(window), return_counts=True)
            s, c = s[c >= SEEN], c[c >= SEEN].astype("<u4")
            return pa.RecordBatch.from_arrays([
                pa.nulls(1, row_type), pa.array([0], pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()),
                pa.array([None], kind), pa.array([s.tobytes()]), pa.array([c.tobytes()])], names=names)

        for b in batches:
            row_type = b.column(0).type
            n, fp, mins = [], [], []
            for s in _sets(b.column("text"), k):
                n.append(len(s))
                fp.append(_signature(s) if len(s) else 0)
                mins.append((s[:, None] * _PERM).min(0).view(np.int64) if len(s) else None)
                window.append(s)
                held += len(s)
                if held >= WINDOW_SHINGLES:
                    yield seen()
                    window, held = [], 0
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.int64()),
                                              pa.array(mins, kind), none, none], names=names)
        if window:
            yield seen()

    return src.mapInArrow(run, out)


def shingle_order(often: DataFrame, limit: int = ORDER_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (sorted) and their place class; at most ``limit`` of them."""
    def rows(batches):
        for b in batches:
            for s, c in zip(b.column("often"), b.column("times")):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s.as_py(), "<i8")),
                                                  pa.array(np.frombuffer(c.as_py(), "<u4").astype(np.int64))], names=["s", "c"])

    counts = cut(often.select("often", "times").mapInArrow(rows, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")), "often")
    top = most_counted(counts, "c", limit).toArrow()
    s = top["s"].to_numpy().view(U64) if len(top) else np.zeros(0, U64)
    c = top["c"].to_numpy() if len(top) else np.zeros(0, np.int64)
    order = np.argsort(s)
    return s[order], c[order]


def _ordered(s: np.ndarray, known: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, int]:
    """A set by (times seen, hash), unlisted shingles first, and how many are unlisted."""
    if not len(known):
        return s, len(s)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    c = np.where(known[at] == s, times[at], 0)
    return s[np.lexsort((s, c))], int((c == 0).sum())


def prefixes(docs: DataFrame, order, text: str, k: int, threshold: int) -> DataFrame:
    """``(fp, n, rare, prefix)`` of every document's set, ``rare`` its unlisted shingles; a task reports a set once."""
    def run(batches):
        known, times = order.value
        done: set[int] = set()
        for b in batches:
            fps, ns, rs, ps = [], [], [], []
            for s in _sets(b.column("text"), k):
                n = len(s)
                if not n:
                    continue
                fp = _signature(s)
                if fp in done:
                    continue
                if len(done) < 1 << 20:                  # only saves repeats; they are dropped later anyway
                    done.add(fp)
                p = n - -(-threshold * n // 100) + 1 + n // EXTEND
                fps.append(fp)
                ns.append(n)
                s, rare = _ordered(s, known, times)
                rs.append(rare)
                ps.append(s[:p].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(rs, pa.int64()),
                                              pa.array(ps, pa.binary())], names=["fp", "n", "rare", "prefix"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "fp long, n long, rare long, prefix binary")


def _to_buckets(batches, buckets: int):
    """Prefix entries of many nodes, packed per bucket of shingles."""
    names = ["bucket", "fp", "comp", "n", "count", "key", "pos"]
    for b in batches:
        if not b.num_rows:
            continue
        data = b.column("prefix")
        size = np.array([len(x) // 8 for x in data.to_pylist()])
        s = np.concatenate([np.frombuffer(x.as_py(), U64) for x in data])
        node = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
        place = ((s >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, node, pos, s = place[order], node[order], pos[order], s[order]
        at = np.flatnonzero(np.diff(place, prepend=-1))
        cols = [b.column(c).to_numpy() for c in ("fp", "comp", "n")]
        rows = []
        for x, y in zip(at, np.append(at[1:], len(s))):
            who, count = np.unique(node[x:y], return_counts=True)   # entries of a node are adjacent, in node order
            rows.append((int(place[x]), *(c[who].astype("<i8").tobytes() for c in cols), count.astype("<u4").tobytes(),
                         (s[x:y] & U64(0xFFFFFFFF)).astype("<u4").tobytes(), pos[x:y].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def _needed(na: np.ndarray, nb: np.ndarray, t: int) -> np.ndarray:
    """Least overlap of sets of sizes na and nb that link."""
    return -(-t * (na + nb) // (100 + t))


def _lists(table: pa.Table, threshold: int) -> pa.Table:
    """Candidate pairs of one bucket's index lists."""
    get = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[c]])
    count = get("count", "<u4").astype(np.int64)
    fp, comp, n = (np.repeat(get(c, "<i8"), count) for c in ("fp", "comp", "n"))
    key, pos = get("key", "<u4"), get("pos", "<u4").astype(np.int64)
    order = np.lexsort((fp, comp, key))
    key, comp, fp, n, pos = key[order], comp[order], fp[order], n[order], pos[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    key, comp, fp, n, pos = key[once], comp[once], fp[once], n[once], pos[once]
    new_list = np.flatnonzero(np.diff(key.astype(np.int64), prepend=-1))
    list_end = np.repeat(np.append(new_list[1:], len(key)), np.diff(np.append(new_list, len(key))))
    new_block = np.ones(len(key), bool)
    new_block[1:] = (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])
    blocks = np.flatnonzero(new_block)
    block_end = np.repeat(np.append(blocks[1:], len(key)), np.diff(np.append(blocks, len(key))))
    partners = list_end - block_end                    # everything in later blocks of the list
    out = []
    who = np.flatnonzero(partners)
    cum = np.cumsum(partners[who])
    lo = 0
    while lo < len(who):
        hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + PAIR_BLOCK, "right")))
        part = who[lo:hi]
        # a very long list is taken in stretches of one entry's partners, so memory stays bounded
        for first in range(0, int(partners[part].max()), PAIR_BLOCK):
            m = np.clip(partners[part] - first, 0, PAIR_BLOCK)
            a = np.repeat(part, m)
            b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(block_end[part] + first, m)
            ok = 100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
            a, b = a[ok], b[ok]
            size = _needed(n[a], n[b], threshold)
            more = 1 + np.minimum(n[a], n[b]) // EXTEND
            ok = (pos[a] < n[a] - size + more) & (pos[b] < n[b] - size + more)
            a, b = a[ok], b[ok]
            swap = fp[a] > fp[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            out.append(_summed(np.stack([fp[a], fp[b], np.ones(len(a), np.int64), more[ok]], 1)))
        lo = hi
    pairs = _summed(np.concatenate(out)) if out else np.zeros((0, 4), np.int64)
    return pa.table(dict(zip(("a", "b", "shared", "needed"), pairs.T)))


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (a, b, shared, needed) with ``shared`` summed per pair."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    at = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[:len(rows)])
    if len(at):
        shared = np.add.reduceat(rows[:, 2], at)
        rows = rows[at]
        rows[:, 2] = shared
    return rows


def texts_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``(th, text)`` once for each text hash in ``wanted``: other texts are left out by a Bloom filter, then by the join."""
    bloom = key_filter(wanted, "th")
    t = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.xxhash64(t).alias("th"), t.alias("text"))

    def run(batches):
        table = bloom.value
        seen: set[int] = set()
        for b in batches:
            keys = b.column("th").to_numpy()
            at = []
            for r in np.flatnonzero(in_filter(table, keys)).tolist():
                th = int(keys[r])
                if th not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(th)
                    at.append(r)
            if at:
                yield b.take(pa.array(at))

    picked = src.mapInArrow(run, "th long, text string").join(wanted.select("th").distinct(), "th", "left_semi")
    return picked.groupBy("th").agg(F.first("text").alias("text"))


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text: str, k: int) -> DataFrame:
    """``(a, b, same, total)``: exact intersection and union sizes of node pairs."""
    th = nodes.select("fp", "th")
    pairs = cut(pairs.join(th.select(F.col("fp").alias("a"), F.col("th").alias("ta")), "a")
                .join(th.select(F.col("fp").alias("b"), F.col("th").alias("tb")), "b"), "pairs")
    wanted = pairs.select(F.col("ta").alias("th")).union(pairs.select("tb"))
    texts = cut(texts_of(docs, wanted, text), "texts")
    both = pairs.join(texts.select(F.col("th").alias("ta"), F.col("text").alias("x")), "ta") \
        .join(texts.select(F.col("th").alias("tb"), F.col("text").alias("y")), "tb")

    def run(batches):
        for b in batches:
            same, total = [], []
            for s, t in zip(_sets(b.column("x"), k), _sets(b.column("y"), k)):
                m = len(np.intersect1d(s, t, assume_unique=True))
                same.append(m)
                total.append(len(s) + len(t) - m)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(same, pa.int64()),
                                              pa.array(total, pa.int64())], names=["a", "b", "same", "total"])

    return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, same long, total long"), "verified")


def leader_pairs(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: each node with the leader of its min-hashes, where enough of them agree.

    The leader is the node with the smallest share of rare shingles, the most
    central one: in a group of edited copies, what they were copied from.
    """
    keys = nodes.select("fp", (F.col("rare") / F.col("n")).alias("own"), F.posexplode("mins").alias("i", "m"))
    lead = keys.groupBy("i", "m").agg(F.min(F.struct("own", "fp")).alias("lead"), F.count("*").alias("c")) \
        .where("c > 1").select("i", "m", F.col("lead.fp").alias("lead"))
    return keys.join(lead, ["i", "m"]).where("fp <> lead").groupBy(F.col("fp").alias("a"), F.col("lead").alias("b")) \
        .agg(F.count("*").alias("c")).where(F.col("c") >= AGREE).select("a", "b")


def link(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", k: int = K,
         threshold: int = THRESHOLD) -> DataFrame:
    """``(row, n_shingles, component_id, component, th)`` for every document.

    ``component`` numbers the group (null for an empty set), ``th`` is the hash of
    the text.
    """
    spark = docs.sparkSession
    names = list(dict.fromkeys([*keep, doc_id]))
    told = cut(describe(docs, names, text, k), "sets")
    rows = told.where("n >= 0").select("row", F.col(f"row.`{doc_id}`").alias("id"), "th", "n", "fp")
    order = spark.sparkContext.broadcast(shingle_order(told.where("n = -1")))
    index = cut(prefixes(docs, order, text, k, threshold), "prefixes")
    nodes = told.where("n > 0").groupBy("fp").agg(F.min("th").alias("th"), F.max("n").alias("n"),
                                                  F.min(f"row.`{doc_id}`").alias("id"), F.max("mins").alias("mins"))
    nodes = cut(nodes.join(index.groupBy("fp").agg(F.min("rare").alias("rare")), "fp"), "nodes")
    linked = F.col("same") * 100 >= F.col("total") * threshold

    # highly similar sets: one computed answer per leader
    first = verify(leader_pairs(nodes), docs, nodes, text, k)
    links = first.where(linked).select("a", "b")
    comps = pair_components(links)
    # each member's leader (itself if it has none) and how far away it is
    best = first.where(linked).groupBy("a").agg(F.max_by(F.struct("b", (1 - F.col("same") / F.col("total")).alias("far")),
                                                         F.struct(F.col("same") / F.col("total"), F.col("b"))).alias("m"))
    lead = nodes.join(best.withColumnRenamed("a", "fp"), "fp", "left") \
        .select("fp", F.coalesce("m.b", "fp").alias("lead"), F.coalesce("m.far", F.lit(0.0)).alias("far"))

    # index lists
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, max(8, -(-size // BUCKET_BYTES))))
    index = index.join(comps.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", F.coalesce("component", "fp").alias("comp"), "n", "prefix")
    packed = index.mapInArrow(lambda it: _to_buckets(it, buckets),
                              "bucket long, fp binary, comp binary, n binary, count binary, key binary, pos binary")
    met = packed.groupBy("bucket").applyInArrow(lambda t: _lists(t, threshold), "a long, b long, shared long, needed long")
    found = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed")) \
        .where("shared >= needed").select("a", "b")
    found = cut(found.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"),
                "candidates")

    # answers derived from the leaders' answers
    la, lb = (lead.select(F.col("fp").alias(c), F.col("lead").alias(f"l{c}"), F.col("far").alias(f"far_{c}")) for c in "ab")
    pairs = found.join(la, "a").join(lb, "b") \
        .withColumns({"x": F.least("la", "lb"), "y": F.greatest("la", "lb")}).where("x <> y")
    pairs = cut(pairs.select("a", "b", "x", "y", (F.col("far_a") + F.col("far_b")).alias("far")), "member-pairs")
    heads = verify(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), docs, nodes, text, k)
    links = links.union(heads.where(linked).select("a", "b"))
    told_by = heads.select(F.col("a").alias("x"), F.col("b").alias("y"), linked.alias("joined"),
                           (1 - F.col("same") / F.col("total")).alias("apart"))
    open_pairs = pairs.join(told_by, ["x", "y"]).where("not joined and not (a = x and b = y)") \
        .where(F.col("apart") <= 1 - threshold / 100 + F.col("far") + 1e-9).select("a", "b")
    rest = verify(open_pairs.distinct(), docs, nodes, text, k)
    links = links.union(rest.where(linked).select("a", "b"))

    comps = pair_components(links)
    named = nodes.join(comps, nodes.fp == comps.node, "left") \
        .select("fp", F.coalesce("component", "fp").alias("component"), "id")
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    by_node = named.join(ids, "component").select("fp", "component_id", "component")
    full = rows.where("n > 0").join(by_node, "fp").select("row", F.col("n").alias("n_shingles"), "component_id", "component", "th")
    bare = rows.where("n = 0").select("row", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"),
                                      F.lit(None).cast("long").alias("component"), "th")
    out = full.unionByName(bare)
    return out if names == keep else out.withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in keep]))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the smallest id (null ids last), then text hash.

    Rows with an empty set all stay.  The columns are those of ``docs``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    got = link(docs, [doc_id], doc_id, text, k, threshold).where("component is not null")
    key = F.struct(F.col(f"row.`{doc_id}`").isNull().alias("none"), F.col(f"row.`{doc_id}`").alias("id"), "th")
    keys = got.select("component", key.alias("key")).groupBy("component", "key").agg(F.count("*").alias("rows"))
    kept = cut(keys.groupBy("component").agg(F.min(F.struct("key", "rows")).alias("m"))
               .select(F.col("m.key.id").alias("_id"), F.col("m.key.th").alias("_th"), F.col("m.rows").alias("_rows")), "kept")
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(t).alias("_th"),
                      F.col(doc_id).alias("id"), t.rlike(r"[^\x20\x09-\x0D]").alias("words"))
    full = src.where("words").join(kept.withColumnRenamed("_th", "kept_th"),
                                   F.col("id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("kept_th")))
    single = full.where("_rows = 1").select("row.*")
    # rows that repeat both id and text
    repeated = full.where("_rows > 1").dropDuplicates(["_id", "kept_th"]).select("row.*")
    return single.unionByName(repeated).unionByName(src.where("not words").select("row.*"))
