"""Mixing, periodic runs and ranked search against brute force, and on odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cootensor.llm import lexical, mixing, periodic, queries
from cootensor.llm.frames import read_table

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_runs(words):
    code = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    found = {}
    for q in range(1, len(code) // 3 + 1):
        same = np.concatenate([[False], code[:-q] == code[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a + q >= max(24, 3 * q):
                found.setdefault((int(a), int(b) + q), q)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    w = SPACED.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query_matches_brute_force(spark, sf):
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect())
    want = sorted(expected_runs(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect())
    assert sum(r[1] for r in want) > 10
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


def test_all_runs_on_hard_sequences():
    rng = np.random.default_rng(5)
    for k in range(250):
        n = int(rng.integers(1, 400))
        w = rng.integers(0, rng.integers(1, 6), n)
        if k % 3 == 0:          # a repeated root that is itself periodic for a while
            d = int(rng.integers(1, 6))
            w = np.resize(np.concatenate([np.resize(np.arange(d), int(rng.integers(20, 80))), rng.integers(0, 3, 5)]), n)
        elif k % 3 == 1 and n > 40:
            a, p = int(rng.integers(0, n - 30)), int(rng.integers(1, 40))
            w[a:] = w[a + np.arange(n - a) % p] if a + p < n else w[a:]
        got = [(int(a), int(b - a), int(q)) for a, b, q in periodic.all_runs(np.append(w + 1, 0))]
        assert got == brute_runs(list(w))


def test_run_candidates_stay_few_on_one_repeated_word():
    order, names = periodic.suffixes(np.append(np.ones(1 << 15, np.int64), 0))
    s, _ = periodic.candidates(order, names)
    assert len(s) < 5 * (1 << 15)


def test_runs_on_odd_documents(odd, none):
    got = {(r.row.doc_id, r.n_words, r.collapsed, len(r.runs)) for r in periodic.scan(odd, odd.columns).collect()}
    by_id = defaultdict(list)
    for i, n, text, runs in got:
        by_id[i].append((n, text, runs))
    assert by_id[2] == by_id[3] == by_id[4] == [(0, "", 0)]
    assert by_id[6] == [(1, "word", 0)]
    n, text, runs = by_id[8][0]
    assert n == 10_001 and runs == 1 and text == "é" * 30_000 + " lorem ipsum dolor sit amet"
    assert periodic.scan(odd, odd.columns).count() == odd.count()
    assert periodic.scan(none, none.columns).count() == 0
    assert periodic.scan(odd, ["doc_id"]).select(periodic.strongest(F.col("runs")).alias("b")).where("b IS NOT NULL").first().b.period == 5


def water(sizes, weights, repeats=3):
    total, full = sum(sizes), {i for i, s in enumerate(sizes) if not s}
    while True:
        left = sum(w for i, w in enumerate(weights) if i not in full)
        rest = total - sum(repeats * sizes[i] for i in full)
        over = {i for i, w in enumerate(weights) if i not in full and w * rest / left > repeats * sizes[i]}
        if not over or not left:
            return [float(repeats * s) if i in full else w * rest / left for i, (s, w) in enumerate(zip(sizes, weights))]
        full |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 1000, 10, 0, 3], [7], [0, 0], [1, 2, 4, 8, 16, 32, 64, 128]])
def test_targets_stop_at_the_limit(spark, sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    rows = spark.createDataFrame([(i, str(i), s, w) for i, (s, w) in enumerate(zip(sizes, weights))],
                                 "source_id long, source_name string, source_size long, weight long")
    got = [r.target for r in mixing.targets(rows).orderBy("source_id").collect()]
    assert np.allclose(got, water(sizes, weights) if sum(sizes) else [0] * len(sizes))


def test_schedule_is_even_and_ranks_are_exact(spark):
    quotas = [(0, 1000), (3, 333), (4, 1), (9, 20_001)]
    got = mixing.schedule(spark.createDataFrame(quotas, "source_id long, quota long"), 10).toPandas().sort_values("slot")
    assert got.slot.is_unique and len(got) == 100 + 34 + 1 + 2001
    for s, q in quotas:
        assert got[got.source_id == s]["rank"].tolist() == list(range(-(-q // 10)))
    share = (got.source_id == 9).to_numpy().cumsum() / np.arange(1, len(got) + 1)
    assert np.abs(share[200:] - 2001 / len(got)).max() < 0.03


def test_running_sums_in_nested_buckets(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(k), int(t), int(v)) for t, (g, k, v) in enumerate(zip(rng.integers(0, 2, 900), rng.integers(0, 1 << 10, 900), rng.integers(0, 9, 900)))]
    got = mixing.running_sums(spark.createDataFrame(rows, "g long, k long, t long, v long"), "g", "k", ["t"], "v", "s", 10, most=16)
    told = {(r.g, r.k, r.t): r.s for r in got.collect()}
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3]):
            assert told[r[:3]] == total
            total += r[3]


def test_mix_keeps_targets_blocks_and_limits(spark, sf):
    docs = read_table(spark, sf, "documents")
    args = (["doc_id", "source"], F.col("source"), F.col("text"), F.col("doc_id"))
    rows, stream = mixing.mix(docs, *args, block=64, most=20)
    told = mixing.taken(rows, stream).withColumn("id", F.col("row.doc_id")).drop("row").toPandas()
    assert len(told) == docs.count() and (told.taken <= 3 * told["size"]).all()
    by = told.groupby("source_id").agg({"taken": "sum", "target": "first"})
    assert (abs(by.taken - by.target) <= 0.5).all()
    parts = stream.toPandas()
    slots = parts.groupby("slot").words.sum()
    assert (slots <= 64).all() and (slots < 64).sum() <= len(by)            # only a source's last block is shorter
    assert (parts.words > 0).all()
    size = told.set_index("n")["size"]
    assert (parts["from"] + parts.words <= parts.n.map(size)).all()
    again = mixing.taken(*mixing.mix(docs.repartition(7), *args, block=64, most=100))
    assert sorted(zip(told.id, told.taken)) == sorted((r.doc_id, r.taken) for r in again.select("row.doc_id", "taken").collect())


def test_mix_on_odd_documents(odd, none):
    docs = odd.withColumn("source", F.when(F.col("doc_id") < 5, F.lit("a")))
    told = mixing.taken(*mixing.mix(docs, docs.columns, F.col("source"), F.col("text"), F.col("doc_id"))).collect()
    assert len(told) == docs.count()
    assert all(r.taken == 0 for r in told if not r["size"])
    assert {r.source_id for r in told if r.row.source is None} == {1}
    assert sum(r.taken for r in told) == sum(r["size"] for r in told)
    assert mixing.taken(*mixing.mix(none, none.columns, F.col("source"), F.col("text"), F.col("doc_id"))).count() == 0


def brute_search(docs, items, k=10):
    texts = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    n, length = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    out = []
    for key, item in items:
        terms = Counter(TERM.findall((item or "").translate(LOW)))
        got = []
        for i, w in texts:
            tf = Counter(w)
            m = 100 - 75 + (75 * len(w) * n) // length if w else 0
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, c in terms.items() if tf[t])
            if s > 0:
                got.append((-s, i is None, i or 0))
        out += [(key, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(got)[:k])]
    return sorted(out, key=str)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi".split()


@pytest.mark.parametrize("block_edges,rounds", [(1 << 19, 4), (25, 3), (1 << 19, 0)])
def test_search_matches_brute_force(spark, block_edges, rounds):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(rng.choice(WORDS, n, p=np.arange(16, 0, -1) / 136))
    docs = [(int(i), text(int(rng.integers(0, 60)))) for i in range(150)] + [(None, text(20)), (7, text(9)), (500, None), (501, "ALPHA-beta, Gamma!")]
    docs += [(600 + i, "alpha beta gamma") for i in range(15)]                               # ties
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(12)] + [(3, "alpha beta"), (None, "alpha"), (20, None), (21, "nothing here"), (22, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(d, b, F.col("doc_id"), ["item_id"], F.col("text"), F.col("text"), rounds=rounds, block_edges=block_edges)
    assert sorted((tuple(r) for r in got.select("row.item_id", "rank", "doc_id", "score").collect()), key=str) == brute_search(docs, items)


def test_search_shares_common_sets(spark):
    shared = " ".join(WORDS[:8])
    items = spark.createDataFrame([(i, f"{shared} own{i} more{i}") for i in range(20)], "item_id long, text string")
    _, terms = lexical.item_terms(items, ["item_id"], F.col("text"))
    _, pairs, uses, blocks = lexical.share(terms)
    assert blocks == 1 and pairs.count() == 7           # one sum of eight terms, three levels of halves
    assert uses.count() == 20 * 3


def test_search_on_odd_documents(odd, none):
    items = odd.limit(3)
    args = (F.col("doc_id"), odd.columns, F.col("text"), F.col("text"))
    got = lexical.search(odd, odd, *args).collect()
    assert {r.rank for r in got if r.row.doc_id == 1} == {1, 2, 3, 4, 5}
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.row.doc_id == 1][:3] == [1, 7, 7]
    assert not [r for r in got if r.row.doc_id in (2, 3, 4)]
    assert lexical.search(none, items, *args).count() == 0 and lexical.search(odd, none, *args).count() == 0
