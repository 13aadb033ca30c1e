r"""Ranked lexical search of many items at once, with common subexpressions evaluated once.

Terms are the words ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` after lower-casing A-Z.
An item's score for a document is a sum of term parts, so items that share terms share
parts of their sums.

* Mining (``share``): the elements of an item are its (term, times) pairs.  In each round
  every element used by two or more items gets the min-hash of its users; elements with
  one min-hash (likely to stand in the same items, sure if they stand in exactly the same)
  are paired off by number of users.  A pair that two or more items hold becomes a new
  element, which replaces it in all of them.  Rounds pair the new elements in turn, so
  shared sets grow to 2^``ROUNDS`` terms: a query-sharing DAG.  Work is linear in the
  items' terms per round; no pairs of items or of terms are listed.
* Evaluation (``search``): a pass over the documents counts them, their terms and the
  documents of each item term.  A second pass computes, for the documents of a batch, the
  part of every term, then every shared element once from its two halves, then every item
  from what it uses.  A task keeps the best ``k`` documents of each item; the tasks' lists
  are merged in two steps.

The items go through in blocks of about ``BLOCK_EDGES`` (item, term) rows, so what is
broadcast is bounded whatever their number (an item is not cut: one item's distinct terms
are the least block).  A term is looked up by its text, not a digest.  All is exact
64-bit integer arithmetic, except the logarithm in a term's weight.

Handling: null or empty texts and texts without terms are not counted as documents, and
as items get no rows.  Equal scores go by ascending doc_id, null ids last.  Repeated
items are answered each, repeated documents are ranked each.  Very long texts are a batch
of their own.  Empty tables give an empty result.  Kept item columns travel in the struct
``row``, so no name clashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import bound_batches, cut
from .text import ALNUM, Words, buffers, chunks

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROUNDS = 4
BLOCK_EDGES = 1 << 19
CELLS = 1 << 21          # numbers of one accumulator table
HELD = 1 << 18           # candidates a task holds before it prunes them
SALTS = 32               # lists per item in the first step of the merge
# Fixed values of the score.
LENGTH_SHARE, TF_SCALE, PART_SCALE, LENGTH_SCALE, WEIGHT_SCALE = 75, 1000, 1_000_000_000, 8, 1000


def item_terms(items: DataFrame, keep: list[str], text: Column) -> tuple[DataFrame, DataFrame]:
    """Items ``(n, row)`` and their terms ``(n, term, times)``."""
    rows = items.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"))
    rows = cut(rows.withColumn("n", F.monotonically_increasing_id()), "items")
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    terms = rows.select("n", F.explode(words).alias("term")).groupBy("n", "term").agg(F.count(F.lit(1)).alias("times"))
    return rows.select("n", "row"), terms


def share(terms: DataFrame, rounds: int = ROUNDS, block_edges: int = BLOCK_EDGES) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The DAG: leaves ``(block, id, term, times)``, pairs ``(block, id, level, a, b)``, uses ``(block, n, id)``, and the blocks' number."""
    terms = cut(terms, "terms")
    blocks = max(1, math.ceil(terms.count() / block_edges))
    name = F.concat_ws(":", F.col("times").cast("string"), "term")
    uses = cut(terms.select(F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int").alias("block"), "n", name.alias("id"), "term", "times"), "uses")
    leaves = uses.select("block", "id", "term", "times").distinct()
    uses = uses.select("block", "n", "id")
    pairs = []
    for level in range(1, rounds + 1):
        users = uses.groupBy("block", "id").agg(F.count(F.lit(1)).alias("users"), F.min(F.xxhash64(F.lit(level), "n")).alias("sign")).where("users > 1")
        place = F.row_number().over(Window.partitionBy("block", "sign").orderBy(F.desc("users"), "id")) - 1
        mates = users.select("block", "id", F.concat_ws(":", F.lit(f"+{level}"), F.col("sign").cast("string"), F.floor(place / 2).cast("string")).alias("pair"))
        tied = cut(uses.join(mates, ["block", "id"], "left"), "tied")
        held = tied.where("pair IS NOT NULL").groupBy("block", "n", "pair").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
        made = cut(held.groupBy("block", "pair", "a", "b").agg(F.count(F.lit(1)).alias("users")).where("users > 1").drop("users"), "pairs")
        if made.isEmpty():
            break
        gone = held.join(made.select("block", "pair"), ["block", "pair"], "left_semi").select("block", "n", "pair", F.lit(True).alias("made"))
        tied = tied.join(gone, ["block", "n", "pair"], "left")
        uses = cut(tied.select("block", "n", F.when(F.col("made"), F.col("pair")).otherwise(F.col("id")).alias("id")).distinct(), "uses")
        pairs.append(made.select("block", F.col("pair").alias("id"), F.lit(level).alias("level"), "a", "b"))
    out = pairs[0] if pairs else leaves.select("block", "id", F.lit(0).alias("level"), F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    for p in pairs[1:]:
        out = out.unionByName(p)
    return leaves, out, uses, blocks


def _plan(leaves: DataFrame, pairs: DataFrame, uses: DataFrame, block: int) -> dict:
    """The DAG of one block as arrays: a place per element, leaves first, then pairs by level."""
    leaf = leaves.where(F.col("block") == block).select("id", "term", "times").orderBy("id").toArrow()
    pair = pairs.where(F.col("block") == block).select("level", "id", "a", "b").orderBy("level", "id").toArrow()
    use = uses.where(F.col("block") == block).select("n", "id").orderBy("n", "id").toArrow()
    names = pa.concat_arrays([leaf["id"].combine_chunks(), pair["id"].combine_chunks()])
    at = lambda col: pc.index_in(col.combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = pc.unique(leaf["term"].combine_chunks())
    level = pair["level"].to_numpy()
    n = use["n"].to_numpy()
    items, first = np.unique(n, return_index=True)
    return {"vocabulary": vocabulary, "term": pc.index_in(leaf["term"].combine_chunks(), value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64),
            "times": leaf["times"].to_numpy(), "a": at(pair["a"]), "b": at(pair["b"]),
            "levels": np.searchsorted(level, np.arange(1, int(level.max(initial=0)) + 2)), "use": at(use["id"]), "first": first, "items": items}


def _terms(data: np.ndarray, off: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row its number of terms; and of the terms in the vocabulary the row and place."""
    w = Words(data, off, ALNUM, hashes=False)
    ends = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(w.end - w.start, out=ends[1:])
    body = np.ascontiguousarray(w.buf[ALNUM[w.buf]])
    words = pa.Array.from_buffers(pa.large_string(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    term = pc.index_in(words, value_set=vocabulary.cast(pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False)
    count = np.diff(w.row)
    row = np.repeat(np.arange(len(count)), count)
    ok = term >= 0
    return count, row[ok], term[ok].astype(np.int64)


def statistics(texts: DataFrame, plan) -> dict[int, int]:
    """Documents per term of the vocabulary; under -1 the documents with a term, under -2 all their terms."""
    def count(batches):
        vocabulary = plan.value["vocabulary"]
        v, df, n_docs, n_terms = len(vocabulary), np.zeros(len(vocabulary), np.int64), 0, 0
        for b in batches:
            data, off = buffers(b["text"])
            for i, j in chunks(off):
                n, row, term = _terms(data[off[i]:off[j]], off[i:j + 1] - off[i], vocabulary)
                n_docs += int((n > 0).sum())
                n_terms += int(n.sum())
                df += np.bincount(np.unique(row * v + term) % v, minlength=v) if v else 0
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [n_docs, n_terms]))], names=["term", "count"])
    rows = texts.select("text").mapInArrow(count, "term long, count long").groupBy("term").agg(F.sum("count").alias("count"))
    got = rows.toArrow()
    return dict(zip(got["term"].to_pylist(), got["count"].to_pylist()))


def _best(held: tuple, k: int) -> tuple:
    """The ``k`` first (item, score, null id, id) of each item: highest score, then smallest id."""
    item, score, none, ident = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((ident, none, -score, item))
    item, score, none, ident = item[order], score[order], none[order], ident[order]
    ok = np.arange(len(item)) - np.searchsorted(item, item) < k
    return item[ok], score[ok], none[ok], ident[ok]


def _evaluate(plan: dict, part: np.ndarray) -> np.ndarray:
    """Item scores (items x documents) from term parts (terms x documents)."""
    n = len(plan["term"])
    acc = np.empty((n + len(plan["a"]), part.shape[1]), np.int64)
    np.multiply(part[plan["term"]], plan["times"][:, None], out=acc[:n])
    for i, j in zip(plan["levels"][:-1], plan["levels"][1:]):
        np.add(acc[plan["a"][i:j]], acc[plan["b"][i:j]], out=acc[n + i:n + j])
    return np.add.reduceat(acc[plan["use"]], plan["first"], axis=0)


def _ranked(texts: DataFrame, plan, k: int) -> DataFrame:
    """Each task's best documents ``(n, score, doc_id)`` per item."""
    def score(batches):
        p = plan.value
        vocabulary, weight, items = p["vocabulary"], p["weight"], p["items"]
        width = max(1, CELLS // (len(p["term"]) + len(p["a"]) + len(p["use"])))
        least, held, n_held = np.ones(len(items), np.int64), [], 0
        for b in batches:
            data, off = buffers(b["text"])
            none = b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ident = b["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in chunks(off):
                n, row, term = _terms(data[off[i]:off[j]], off[i:j + 1] - off[i], vocabulary)
                key, tf = np.unique(row * len(vocabulary) + term, return_counts=True)
                row, term = key // len(vocabulary), key % len(vocabulary)
                m = 100 - LENGTH_SHARE + LENGTH_SHARE * n.astype(np.int64) * p["docs"] // p["terms"]
                value = weight[term] * (PART_SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m[row]))
                for a in range(0, j - i, width):
                    z = min(a + width, j - i)
                    u, v = np.searchsorted(row, [a, z])
                    part = np.zeros((len(vocabulary), z - a), np.int64)
                    part[term[u:v], row[u:v] - a] = value[u:v]
                    got = _evaluate(p, part)
                    if z - a > k:
                        least = np.maximum(least, np.partition(got, z - a - k, axis=1)[:, z - a - k])
                    item, at = np.nonzero(got >= least[:, None])
                    held.append((item, got[item, at], none[i + a + at], ident[i + a + at]))
                    n_held += len(item)
                    if n_held > HELD:
                        held = [_best(held, k)]
                        n_held = len(held[0][0])
        if n_held:
            item, got, none, ident = _best(held, k)
            yield pa.RecordBatch.from_arrays([pa.array(items[item]), pa.array(got), pa.array(ident, mask=none)], names=["n", "score", "doc_id"])
    return texts.select("doc_id", "text").mapInArrow(score, "n long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, doc_id: Column, keep: list[str], doc_text: Column, item_text: Column,
           k: int = 10, rounds: int = ROUNDS, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """Rows ``(row, rank, doc_id, score)``: per item its ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows, terms = item_terms(items, keep, item_text)
    leaves, pairs, uses, blocks = share(terms, rounds, block_edges)
    texts = docs.select(doc_id.cast("long").alias("doc_id"), doc_text.alias("text"))
    best = None
    for block in range(blocks):
        plan = _plan(leaves, pairs, uses, block)
        if not len(plan["items"]):
            continue
        seen = statistics(texts, spark.sparkContext.broadcast(plan))
        plan["docs"], plan["terms"] = seen.get(-1, 0), max(1, seen.get(-2, 0))
        plan["weight"] = np.array([math.floor(WEIGHT_SCALE * math.log((2 * plan["docs"] + 2) / (2 * seen.get(t, 0) + 1)))
                                   for t in range(len(plan["vocabulary"]))], np.int64)
        got = _ranked(texts, spark.sparkContext.broadcast(plan), k)
        best = got if best is None else best.unionByName(got)
    if best is None:
        best = spark.createDataFrame([], "n long, score long, doc_id long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    salted = Window.partitionBy("n", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(*order)).cast("int")).where(F.col("rank") <= k)
    return best.join(rows, "n").select("row", "rank", "doc_id", "score")
