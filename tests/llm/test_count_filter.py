"""The count filter keeps every count at any size, and the model's score equals its formula."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from cootensor.llm import lm, queries
from cootensor.llm.frames import read_table


def _brute(rows):
    """Scores from a dictionary of counts, quantised as the filter does."""
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t, _ in rows}
    one, two = Counter(), Counter()
    for i, _, held in rows:
        if not held:
            one.update(tokens[i])
            two.update(zip(["<", *tokens[i]], tokens[i]))
    told = lambda n: n if n < 2 else 1.5 * 2 ** int(math.log2(n))
    total = sum(one.values()) + len(one) + 1
    out = {}
    for i, t in tokens.items():
        s = 0.0
        for u, w in zip(["<", *t], t):
            context = told(one[None if u == "<" else u])
            pair = min(told(two[u, w]), context)
            s += math.log10((pair + lm.MU * min(1, (told(one[w]) + 1) / total)) / (context + lm.MU))
        out[i] = min(0.0, s)
    return out


def _rows(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", queries.split(F.col("doc_id"), 7, 2).alias("held"))
    return docs, [(r.doc_id, r.text, r.held) for r in docs.collect()]


def test_score_is_its_formula(spark, sf):
    docs, rows = _rows(spark, sf)
    want = _brute(rows)
    got = {r.doc_id: r.score for r in lm.score(docs, ["doc_id"], F.col("held"), entry_bits=256).select("row.doc_id", "score").collect()}
    assert got.keys() == want.keys()
    off = [i for i in got if abs(got[i] - want[i]) > 1e-9 * max(1, abs(want[i]))]
    assert len(off) <= 0.1 * len(got)                     # a false member of the filter may change a text's score
    assert all(abs(got[i] - want[i]) < 0.01 * max(1, abs(want[i])) for i in got)


def test_a_filter_too_large_to_broadcast_gives_the_same_scores(spark, sf, odd):
    docs, _ = _rows(spark, sf)
    for d, held in ((docs, F.col("held")), (odd, F.col("doc_id") == 1)):
        held = F.coalesce(held, F.lit(False))
        a = lm.score(d, ["doc_id"], held).select("row.doc_id", "n_tokens", "base_score", "score")
        b = lm.score(d, ["doc_id"], held, max_filter_bytes=64 << 10 if d is docs else 0).select("row.doc_id", "n_tokens", "base_score", "score")
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score)
        assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)


def test_no_count_is_left_out(spark):
    """Segments grow with their entries: every pair that was counted is a member, also the rare ones."""
    words = [f"w{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(k, " ".join(words[k::50])) for k in range(50)], "doc_id long, text string")
    got = lm.score(docs, ["doc_id"], F.lit(False), max_filter_bytes=1024, entry_bits=256).select("score", "n_tokens").collect()
    total = 20_050 + 20_001 + 1
    ends = 1.5 * 2 ** 5                                   # 50 ends and begins, as their level tells it
    per = math.log10((1 + lm.MU * 2 / total) / (1 + lm.MU))
    least = 399 * per + math.log10((1 + lm.MU * 2 / total) / (ends + lm.MU)) + math.log10((1 + lm.MU * (ends + 1) / total) / (1 + lm.MU))
    unseen = 399 * math.log10(lm.MU * 2 / total / (1 + lm.MU))     # the score if pairs were left out
    assert unseen < 1.5 * least < least
    assert all(r.n_tokens == 401 and r.score >= 1.01 * least for r in got)       # a false member raises a context now and then
