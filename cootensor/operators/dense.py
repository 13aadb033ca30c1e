"""Fiber outer-product sums, computed inside tasks.

Σ_f a_f b_fᵀ over fibers f (the Gram of an unfolding when a = b, the cross
moment Y X̄ᵀ otherwise).  A self-join on the fiber key would emit every pair of
entries of a fiber as a row; instead Spark groups each fiber once (repeated
coordinates are summed first, so a fiber holds one entry per index) and cuts it
into blocks of ``tile`` indices and fragments of ``FRAGMENT`` blocks; a row holds
a fragment, and two fragments of a long fiber meet in a cell of their own.  A task meets its pairs of blocks ordered by
tile, folds them into one dense tile x tile buffer with numpy (BLAS for dense
chunks, vectorised pair products for sparse ones) and emits each finished tile
as packed rows: at most one row per index and tile leaves a task.  There is no
limit on the mode dimension, and one path for every dimension.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import TILE_DIM, VALUE

# This module's functions run inside Python workers.  Ship them by value so a
# worker needs no copy of this package on its path (e.g. a driver started
# outside the repository, or executors without --py-files).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAGMENT = 16                 # blocks of a fiber one row holds at most
_PAIR_BUDGET = 4_000_000      # pair products per vectorised chunk
_DENSE_BUDGET = 4_000_000     # doubles per dense chunk block


def _lists(rb: pa.RecordBatch, idx_name: str, val_name: str):
    idx = rb.column(rb.schema.get_field_index(idx_name))
    val = rb.column(rb.schema.get_field_index(val_name))
    lens = pc.fill_null(pc.list_value_length(idx), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat_i = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    flat_v = val.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return lens, flat_i, flat_v


def _ragged(lens: np.ndarray) -> np.ndarray:
    """Position of each element inside its own list."""
    total = int(lens.sum())
    starts = np.repeat(np.cumsum(lens) - lens, lens)
    return np.arange(total, dtype=np.int64) - starts


class _Acc:
    def __init__(self):
        self.g = np.zeros((0, 0))

    def grow(self, da: int, db: int):
        ra, rb = self.g.shape
        if da > ra or db > rb:
            g = np.zeros((max(da, ra), max(db, rb)))
            g[:ra, :rb] = self.g
            self.g = g


def _accumulate(acc: _Acc, la, ia, va, lb, ib, vb):
    n = len(la)
    if n == 0 or len(ia) == 0 or len(ib) == 0:
        return
    da = int(ia.max()) + 1
    db = int(ib.max()) + 1
    acc.grow(da, db)
    da, db = acc.g.shape
    offa = np.concatenate(([0], np.cumsum(la)))
    offb = np.concatenate(([0], np.cumsum(lb)))
    pairs_per_row = la * lb
    r0 = 0
    while r0 < n:
        # grow the chunk while both budgets hold
        cum_pairs = np.cumsum(pairs_per_row[r0:])
        r1 = r0 + max(1, int(np.searchsorted(cum_pairs, _PAIR_BUDGET, side="right")))
        r1 = min(r1, n)
        npairs = int(pairs_per_row[r0:r1].sum())
        rows = r1 - r0
        dense_cost = rows * da * db / 200.0
        if npairs > dense_cost and rows * max(da, db) <= _DENSE_BUDGET:
            A = np.zeros(rows * da)
            B = np.zeros(rows * db)
            sa = slice(offa[r0], offa[r1])
            sb = slice(offb[r0], offb[r1])
            rowa = np.repeat(np.arange(rows), la[r0:r1])
            rowb = np.repeat(np.arange(rows), lb[r0:r1])
            np.add.at(A, rowa * da + ia[sa], va[sa])
            np.add.at(B, rowb * db + ib[sb], vb[sb])
            acc.g += A.reshape(rows, da).T @ B.reshape(rows, db)
        elif npairs:
            # every a-entry meets every b-entry of its own fiber
            ea = np.arange(offa[r0], offa[r1])
            rowa = np.repeat(np.arange(r0, r1), la[r0:r1])
            cnt = lb[rowa]
            rep = np.repeat(ea, cnt)
            pos = _ragged(cnt)
            eb = offb[np.repeat(rowa, cnt)] + pos
            flat = ia[rep] * db + ib[eb]
            acc.g += np.bincount(flat, weights=va[rep] * vb[eb], minlength=da * db).reshape(da, db)
        r0 = r1


def _emit(g: np.ndarray, ba: int, bb: int, tile: int, upper: bool):
    """One finished tile as packed rows ``(_1, js, vs)``."""
    if upper and ba == bb:
        g = np.triu(g)
    i, j = np.nonzero(g)
    if len(i) == 0:
        return
    rows, counts = np.unique(i, return_counts=True)
    off = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [pa.array((rows + ba * tile).astype(np.int32)),
         pa.ListArray.from_arrays(off, pa.array((j + bb * tile).astype(np.int32))),
         pa.ListArray.from_arrays(off, pa.array(g[i, j]))],
        names=["_1", "js", "vs"])


def _kernel(symmetric: bool, tile: int):
    """Block pairs come ordered by tile, so a task holds one tile at a time."""
    def run(batches):
        cur, acc = None, _Acc()
        for rb in batches:
            ba = rb.column(rb.schema.get_field_index("ba")).to_numpy()
            bb = rb.column(rb.schema.get_field_index("bb")).to_numpy()
            cuts = np.flatnonzero((ba[1:] != ba[:-1]) | (bb[1:] != bb[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ba)]):
                if hi == lo:
                    continue
                here = (int(ba[lo]), int(bb[lo]))
                if cur is not None and here != cur:
                    yield from _emit(acc.g, *cur, tile, symmetric)
                    acc = _Acc()
                cur = here
                part = rb.slice(lo, hi - lo)
                _accumulate(acc, *_lists(part, "ia", "va"), *_lists(part, "ib", "vb"))
        if cur is not None:
            yield from _emit(acc.g, *cur, tile, symmetric)
    return run


def _fragments(entries: DataFrame, tile: int) -> DataFrame:
    """``(__k, __f, bs)``: the blocks ``(s, blk, e)`` of each fragment of each fiber, from entries ``(__k, s, i, v)``.

    A fragment is a range of ``FRAGMENT`` blocks of the index, so a row is bounded
    whatever the length of its fiber, and a long fiber is spread over tasks.  One
    shuffle by (fiber, fragment) serves the sum over repeated coordinates and
    both groupings.
    """
    one = entries.withColumn("__f", F.expr(f"i div {int(tile) * FRAGMENT}").cast("int")).repartition("__k", "__f")
    one = one.groupBy("__k", "__f", "s", "i").agg(F.sum("v").alias("v"))
    blk = (one.groupBy("__k", "__f", "s", F.expr(f"i div {int(tile)}").cast("int").alias("blk"))
           .agg(F.collect_list(F.struct((F.col("i") % int(tile)).cast("int").alias("i"), "v")).alias("e")))
    return blk.groupBy("__k", "__f").agg(F.collect_list(F.struct("s", "blk", "e")).alias("bs"))


def _far(fragments: DataFrame) -> DataFrame:
    """``(l, r)``: the blocks of every two fragments of a fiber, the first fragment left.

    Fragment and replicate: a fiber of n fragments is a grid of n (n - 1) / 2 cells;
    each fragment goes to the n - 1 cells it takes part in, and each cell is a row of
    its own after one shuffle by (fiber, cell).  Only fibers of two fragments or more
    take part, told by their fragment numbers.
    """
    several = fragments.groupBy("__k").agg(F.collect_set("__f").alias("fs")).where(F.size("fs") > 1)
    sent = fragments.join(several, "__k").select("__k", "__f", "bs", F.explode("fs").alias("o")).where("o <> __f")
    cells = sent.groupBy("__k", F.least("__f", "o").alias("fa"), F.greatest("__f", "o").alias("fb")) \
        .agg(F.array_sort(F.collect_list(F.struct("__f", "bs"))).alias("both"))
    return cells.select(F.col("both")[0]["bs"].alias("l"), F.col("both")[1]["bs"].alias("r"))


def _entries(u: DataFrame, side: int) -> DataFrame:
    key, idx, val = u.columns[:3]
    e = u.select(F.col(key).alias("__k"), F.lit(side).alias("s"), F.col(idx).cast("int").alias("i"),
                 F.col(val).cast("double").alias("v"))
    return e.filter(F.col("i").isNotNull() & F.col("v").isNotNull())     # a null cell is absent


def _fold(entries: DataFrame, symmetric: bool, tile: int, dim: int | None) -> DataFrame:
    """Sum the outer products of block pairs into COO ``(_1, _2, product)``.

    ``dim`` is the largest index plus one, asked for here if the caller does not
    know it: where every fiber lies in one fragment, no two fragments need to meet
    and the plan is one pass over the entries.
    """
    if dim is None:
        dim = (entries.agg(F.max("i")).first()[0] or 0) + 1
    rows = _fragments(entries, tile)
    side = lambda c, s: F.filter(c, lambda b: b["s"] == s)
    if symmetric:
        pairs = rows.select("bs", F.explode("bs").alias("a")).select(
            "a", F.explode(F.filter("bs", lambda b: b["blk"] >= F.col("a.blk"))).alias("b"))
    else:
        pairs = rows.select(side("bs", 1).alias("r"), F.explode(side("bs", 0)).alias("a")).select("a", F.explode("r").alias("b"))
    if dim > tile * FRAGMENT:
        far = _far(rows)
        if symmetric:
            pairs = pairs.unionByName(far.select("r", F.explode("l").alias("a")).select("a", F.explode("r").alias("b")))
        else:
            for x, y in (("l", "r"), ("r", "l")):
                pairs = pairs.unionByName(far.select(side(y, 1).alias("__o"), F.explode(side(x, 0)).alias("a")).select("a", F.explode("__o").alias("b")))
    pairs = pairs.select(F.col("a.blk").alias("ba"), F.col("b.blk").alias("bb"),
                         F.col("a.e.i").alias("ia"), F.col("a.e.v").alias("va"),
                         F.col("b.e.i").alias("ib"), F.col("b.e.v").alias("vb"))
    packed = pairs.sortWithinPartitions("ba", "bb").mapInArrow(
        _kernel(symmetric, int(tile)), "_1 int, js array<int>, vs array<double>")
    # packed rows cross the shuffle; the sum by cell needs no further exchange
    cells = packed.repartition("_1").select("_1", F.inline(F.arrays_zip("js", "vs")).alias("_2", VALUE))
    return cells.groupBy("_1", "_2").agg(F.sum(VALUE).alias(VALUE))


def fiber_gram(u: DataFrame, tile: int = TILE_DIM, upper_only: bool = False, dim: int | None = None) -> DataFrame:
    """Gram ``G[i, j] = Σ_key U[key, i] U[key, j]`` of an unfolding ``(key, idx, v)``."""
    g = _fold(_entries(u, 0), True, tile, dim)
    if upper_only:
        return g
    # mirror the strict upper triangle without a second scan or a union
    pairs = F.when(F.col("_1") == F.col("_2"), F.array(F.struct("_1", "_2", VALUE))).otherwise(
        F.array(F.struct("_1", "_2", VALUE),
                F.struct(F.col("_2").alias("_1"), F.col("_1").alias("_2"), F.col(VALUE))))
    return g.select(F.inline(pairs))


def fiber_cross(a: DataFrame, b: DataFrame, tile: int = TILE_DIM) -> DataFrame:
    """``C[i, j] = Σ_key A[key, i] B[key, j]`` for two unfoldings on the same key space.

    Both sides are cogrouped by the key in one shuffle (union + group by).
    """
    return _fold(_entries(a, 0).unionByName(_entries(b, 1)), False, tile, None)
