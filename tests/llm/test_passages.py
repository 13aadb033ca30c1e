"""Shared passages of 26 words and more are found wherever they stand: the whole query against brute force."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cootensor.llm import queries, substring
from cootensor.llm.frames import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _windows(text, size):
    """Windows of ``size`` words with their places."""
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    words = WORD.findall(_fold(text))
    return [(" ".join(words[i:i + size]), at[i][0], at[i + size - 1][1]) for i in range(len(words) - size + 1)]


def _check(docs, got):
    stretches, where = defaultdict(list), defaultdict(set)
    for r in got:
        stretches[r.doc_id].append((r.start, r.end))
    for i, text in docs:
        for w, _, _ in _windows(text, substring.SURE):
            where[w].add(i)
    for i, text in docs:
        for w, a, b in _windows(text, substring.SURE):
            if len(where[w]) > 1:
                assert any(min(b, y) > max(a, x) for x, y in stretches[i]), (i, a, b)
    shingles = defaultdict(set)
    for i, text in docs:
        for w, _, _ in _windows(text, substring.K):
            shingles[w].add(i)
    by = defaultdict(list)
    for i, text in docs:
        by[i].append(text)
    for r in got:                                        # nothing is reported that no other document resembles
        inside = {w for text in by[r.doc_id] for w, a, b in _windows(text, substring.K) if a >= r.start and b <= r.end}
        assert any(len(shingles[w]) > 1 for w in inside), r


@pytest.mark.parametrize("length", [26, 30, 35, 40])
def test_every_passage_has_a_paragraph(length):
    """300 pairs of texts of 100 words with a passage in common, and as many of the passage and 10 words."""
    rng = np.random.default_rng(length)
    text = lambda n: [f"{x:x}" for x in rng.integers(0, 1 << 60, n)]
    pairs = []
    for total in [100] * 300 + [length + 10] * 300:
        p = text(length)
        for _ in range(2):
            at = int(rng.integers(0, total - length + 1))
            pairs.append(" ".join(text(at) + p + text(total - length - at)))
    classes = defaultdict(set)
    for i, _, _, p in substring._chunks(pa.array(pairs)):
        for row, sig in zip((p.row + i).tolist(), p.sig.tolist()):
            classes[row].add(sig)
    assert all(classes[k] & classes[k + 1] for k in range(0, len(pairs), 2))


def test_query_finds_every_shared_passage(spark, sf):
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]
    _check(docs, queries.op4_substring_dedup(spark, sf).collect())


def test_planted_passages_of_all_lengths(spark):
    rng = np.random.default_rng(11)
    text = lambda n: [f"{x:x}" for x in rng.integers(0, 1 << 40, n)]
    docs = [(1000, " ".join(text(60)))]
    for k in range(60):
        p = text(20 + k)
        docs += [(2 * k + j, " ".join(text(int(rng.integers(0, 40))) + p + text(int(rng.integers(0, 40))))) for j in range(2)]
    docs += [(2000, "one two three four five six"), (2001, "One two three four five six"), (2002, "one two three")]
    got = substring.duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    _check(docs, got)
    ids = {r.doc_id for r in got}
    assert {2000, 2001} <= ids and not {1000, 2002} & ids
    assert {2 * k + j for k in range(6, 60) for j in range(2)} <= ids
