"""Left singular vectors of an unfolding up to a residual, its rank found on the way.

A random sketch W = U Ω of the unfolding grows by doubling: Ω is a seeded hash of
(fiber, column), so it is never stored and the columns drawn before stay valid.  The
sketch is orthonormalised (Q), U is projected (Z = Qᵀ U), and ``||U||² - ||Z||²`` is the
squared residual.  Growth ends when the residual is at most ``tol * ||U||`` or the sketch
is as wide as U has indices.  Block power steps (W = U Z) then turn Q to the leading
directions and a Rayleigh-Ritz step gives vectors and values.

Distributed are U (entries), W and Q (a row per index with ``width`` numbers) and Z
(a row per fiber and column).  Only ``width x width`` matrices meet in one task; the
width follows the rank, not the dimension.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hash_uniform
from ..operators.dense import fiber_gram
from ..session import MAX_LOCAL_DIM, VALUE
from ..sources.runstore import RunStore
from .solve import _expand, _project

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_TOL = 1e-6       # residual share at which the range counts as found
_DROPPED = 1e-14       # share of the largest eigenvalue below which a sketch direction is rounding
_PACKED = "j long, q array<double>"


def _sketch(u: DataFrame, first: int, last: int, seed: int) -> DataFrame:
    """Columns ``first .. last - 1`` of W = U Ω as ``(j, c, w)``."""
    key, idx, val = u.columns[:3]
    wide = u.select(F.col(key).alias("key"), F.col(idx).cast("long").alias("j"), F.col(val).alias("v"),
                    F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("c"))
    return wide.groupBy("j", "c").agg(F.sum(F.col("v") * (hash_uniform(seed, "key", "c") - F.lit(0.5))).alias("w"))


def _symmetric(g: DataFrame, width: int) -> np.ndarray:
    """A ``width x width`` COO matrix as an array (``width`` <= MAX_LOCAL_DIM)."""
    pdf = g.select("_1", "_2", VALUE).toPandas()
    a = np.zeros((width, width))
    a[pdf["_1"].to_numpy(), pdf["_2"].to_numpy()] = pdf[VALUE].to_numpy()
    return (a + a.T) / 2


def _pack(w: DataFrame, width: int) -> DataFrame:
    """``(j, c, w)`` as one dense row of ``width`` numbers per index."""
    got = w.groupBy("j").agg(F.map_from_entries(F.collect_list(F.struct("c", "w"))).alias("m"))
    cell = lambda c: F.coalesce(F.element_at("m", c.cast("int")), F.lit(0.0))
    return got.select("j", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), cell).alias("q"))


def _cells(q: DataFrame) -> DataFrame:
    return q.select("j", F.posexplode("q").alias("c", "q"))


def _times(q: DataFrame, m: np.ndarray) -> DataFrame:
    """Every packed row times ``m``."""
    def run(batches):
        for b in batches:
            if len(b):
                rows = np.stack(b["q"].to_numpy()) @ m
                yield pd.DataFrame({"j": b["j"], "q": list(rows)})
    return q.mapInPandas(run, _PACKED)


def _orthonormal(w: DataFrame, width: int, store: RunStore) -> tuple[DataFrame, int]:
    """Orthonormal basis of the columns of W, packed, and its width.  Directions that
    are rounding are left out; a second pass removes what the first one's Gram blurred."""
    q = store.cut(_pack(w, width))
    for _ in range(2):
        s, v = np.linalg.eigh(_symmetric(fiber_gram(_cells(q), dim=width), width))
        kept = s > _DROPPED * max(s.max(), 0.0)
        if not kept.any():
            return q, 0
        q = store.cut(_times(q, v[:, kept] / np.sqrt(s[kept])))
        width = int(kept.sum())
    return q, width


def range_vectors(u: DataFrame, tol: float = RANGE_TOL, start: int = 32, power: int = 1,
                  max_rank: int = MAX_LOCAL_DIM, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """``(factor, singular values)``: the fewest leading left singular vectors of the
    unfolding ``(key, idx, value)`` that leave a residual of at most ``tol * ||U||``.

    The factor is ``(_1 = component, _2 = index, value)``, largest value first, signs as
    they come.  No entries, or zeros only: no components.  Null cells are absent, repeated
    ones are summed.
    ``tol`` below 1e-7 is refused: a residual is known to the square root of rounding.
    A range wider than ``max_rank`` at ``tol`` raises; nothing is cut off silently.
    """
    if tol < 1e-7:
        raise ValueError(f"tol={tol}: a residual below 1e-7 cannot be told from rounding")
    spark = u.sparkSession
    key, idx, val = u.columns[:3]
    u = u.where(F.col(idx).isNotNull()).groupBy(key, idx).agg(F.sum(val).alias(val)).where(F.col(val) != 0).checkpoint(eager=True)
    norm, d = u.agg(F.sum(F.col(val) * F.col(val)), F.count_distinct(F.col(idx))).first()
    if not d or not norm:
        return spark.createDataFrame([], f"_1 int, _2 int, {VALUE} double"), np.zeros(0)
    store = RunStore(spark)
    width, w = min(start, d, max_rank), None
    w = store.cut(_sketch(u, 0, width, seed))
    while True:
        q, rank = _orthonormal(w, width, store)
        z = store.cut(_project(u, _cells(q)))
        left = norm - (z.agg(F.sum(F.col("z") * F.col("z"))).first()[0] or 0.0)
        if left <= tol * tol * norm or width == d:
            break
        if width == max_rank:
            raise ValueError(f"residual {max(left, 0.0) ** 0.5:.3g} of norm {norm ** 0.5:.3g} at rank {max_rank}: "
                             "raise tol or max_rank")
        wider = min(2 * width, d, max_rank)
        w = w.unionByName(store.cut(_sketch(u, width, wider, seed)))
        width = wider
    for _ in range(power if rank < d else 0):         # a basis of all indices has nothing to turn to
        q, rank = _orthonormal(_expand(u, z).withColumn("j", F.col("j").cast("long")), rank, store)
        z = store.cut(_project(u, _cells(q)))
    s, v = np.linalg.eigh(_symmetric(fiber_gram(z.select("key", "c", "z"), dim=rank), rank))
    s, v = np.maximum(s[::-1], 0.0), v[:, ::-1]
    r = int((np.cumsum(s[::-1])[::-1] > tol * tol * norm).sum())
    f = _cells(_times(q, v[:, :r].copy()))
    f = f.select(F.col("c").cast("int").alias("_1"), F.col("j").cast("int").alias("_2"), F.col("q").alias(VALUE)).checkpoint(eager=True)
    store.drop()
    return f, np.sqrt(s[:r])
