"""Tucker factorization by higher-order orthogonal iteration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import HOOI_SWEEPS
from ..functions.expr import hash_uniform, lcg_uniform
from ..operators.algebra import ttm, ttm_chain
from ..operators.joins import sized_broadcast
from ..operators.reshape import transpose, unfold
from ..session import VALUE
from ..sources.io import index_grid
from ..tensor import modes_of, shape_of
from .solve import fiber_eigvecs, leading_eigvecs

MAX_FIBERS = 512          # product of the other ranks up to which HOOI solves the fibers' Gram in one task


def _factor_grids(t: DataFrame, ranks: list[int], value: str = VALUE) -> list[DataFrame]:
    """``rank x dim`` index grids (``_1`` = rank index, ``_2`` = mode index),
    dims from the tensor's own shape, generated lazily on the executors."""
    modes = modes_of(t, value)
    shape = shape_of(t, value)               # one-row collect (D-6), never a matrix
    spark = t.sparkSession
    return [index_grid(spark, [int(r), d], ["_1", "_2"]) for r, d in zip(ranks, shape)]


def random_factors(t: DataFrame, ranks: list[int], seed: int = 0, value: str = VALUE) -> list[DataFrame]:
    """Random Tucker factors ``rank x (max + 1)``, uniform [0, 1).

    Seeded hash of (seed, mode, row, column): reproducible and independent of
    partitioning, unlike unseeded driver random numbers (D11).
    """
    return [g.select("_1", "_2", hash_uniform(seed * 1009 + i, "_1", "_2").alias(VALUE))
            for i, g in enumerate(_factor_grids(t, ranks, value))]


def lcg_factors(t: DataFrame, ranks: list[int], seed: int = 0, value: str = VALUE) -> list[DataFrame]:
    """Like ``random_factors`` but entries from the integer LCG, reproducible
    in plain SQL as well."""
    return [g.select("_1", "_2", lcg_uniform("_1", "_2", seed + i).alias(VALUE))
            for i, g in enumerate(_factor_grids(t, ranks, value))]


def tucker_core(t: DataFrame, factors: list[DataFrame], **kw) -> DataFrame:
    """Core projection ``G = T x_1 F_1 ... x_N F_N``."""
    return ttm_chain(t, factors, **kw)


def reconstruct(g: DataFrame, factors: list[DataFrame], **kw) -> DataFrame:
    """``G x_1 F_1ᵀ ... x_N F_Nᵀ``."""
    return ttm_chain(g, [transpose(f) for f in factors], **kw)


def reconstruct_at(t: DataFrame, g: DataFrame, factors: list[DataFrame], value: str = VALUE) -> DataFrame:
    """The reconstruction at the stored cells of ``t`` only (I10 for J10).

    Each cell meets the factor rows of its indices and then the core: work is
    cells x product of ranks, and the grid of all cells is never built.
    """
    modes = modes_of(t, value)
    out = t.select(*modes, F.lit(1.0).alias("__w"))
    for n, (m, f) in enumerate(zip(modes, factors)):
        ff = sized_broadcast(f.select(F.col("_2").alias("__j"), F.col("_1").alias(f"__r{n}"), F.col(f.columns[2]).alias("__f")))
        out = out.join(ff, F.col(m) == F.col("__j")).withColumn("__w", F.col("__w") * F.col("__f")).drop("__j", "__f")
    ranks = [f"__r{n}" for n in range(len(modes))]
    core = g.select(*[F.col(m).alias(r) for m, r in zip(modes_of(g, value), ranks)], F.col(value).alias("__g"))
    out = out.join(sized_broadcast(core), ranks)
    return out.groupBy(*modes).agg(F.sum(F.col("__w") * F.col("__g")).alias(value))


def factor_ranks(factors: list[DataFrame]) -> list[int]:
    """rank_i = max(_1) + 1 of each initial factor."""
    return [int((f.agg(F.max("_1")).first()[0] or 0) + 1) for f in factors]


def hooi(t: DataFrame, factors: list[DataFrame], n_iter: int = HOOI_SWEEPS, tol: float | None = None,
         top_k: int | None = None, route: str = "auto", store=None, value: str = VALUE,
         reuse: bool = True, norms: list | None = None, **eig_kw) -> list[DataFrame]:
    """Higher-order orthogonal iteration.

    For every sweep and mode i: Y = T projected on every other factor (the
    chain with ``skip=i``, lineage cut after each product); new factor i = the
    leading ``rank_i`` left singular vectors of Y's mode-i unfolding.  Factor i
    is used by mode i+1 at once.  ``tol`` stops when the core norm changes by
    less than ``tol`` (relative); the reference always runs ``n_iter``.
    Factors are stored per (iter, mode) in ``store`` (a ``RunStore``) or
    checkpointed.  A store with committed factors (a run that was stopped) is gone
    on with after the last of them.

    ``reuse``: the last factor does not change before the last update of a
    sweep, so ``C = T x_last F_last`` is formed once per sweep (checkpointed)
    and the other updates start from C instead of T.  A sweep then reads the
    full tensor twice instead of once per mode.  Mode products commute, so
    the result is the same; with ``top_k`` the truncation points would move,
    so the plain per-mode chain is kept there.

    ``route="auto"``: the projected unfolding has as many fibers as the product of the
    other ranks.  Up to ``MAX_FIBERS`` of them the vectors come from the fibers' own Gram
    (``fiber_eigvecs``), whatever the mode's size; beyond, or where the unfolding has fewer
    components than the rank, from ``leading_eigvecs``.

    ``norms``: when a list is given, the core norm after every sweep is
    appended to it (one extra chain and one-row aggregate per sweep).
    """
    modes = modes_of(t, value)
    ranks = factor_ranks(factors)
    fs = list(factors)
    n = min(len(fs), len(modes))
    # T is read by every mode of every sweep: cut its lineage once
    t = t.checkpoint(eager=True)
    last = None
    done = store.committed() if store is not None else set()
    for it in range(n_iter):
        cache = None
        for i in range(n):
            m = modes[i]
            if (it, i) in done:
                fs[i] = store.load_factor(it, i)
                continue
            if reuse and top_k is None and n >= 2 and i < n - 1:
                if cache is None:
                    cache = ttm(t, fs[n - 1], modes[n - 1], value).checkpoint(eager=True)
                rest = [None if j in (i, n - 1) else fs[j] for j in range(n)]
                y = ttm_chain(cache, rest, value=value, checkpoint=True)
            else:
                y = ttm_chain(t, fs, skip=i, value=value, top_k=top_k, checkpoint=True)
            new = None
            sizes = [r for j, r in enumerate(ranks[:n]) if j != i]
            if route == "auto" and n == len(modes) and math.prod(sizes) <= MAX_FIBERS:
                new = fiber_eigvecs(unfold(y, m, value), ranks[i], sizes)
            if new is None:
                new = leading_eigvecs(unfold(y, m, value), ranks[i], route=route, **eig_kw)
            new = new.filter(F.abs(F.col(VALUE)) > 0)
            fs[i] = store.save_factor(new, it, i) if store is not None else new.checkpoint(eager=True)
        if tol is not None or norms is not None:
            g = tucker_core(t, fs, value=value)
            norm = g.agg(F.sqrt(F.sum(F.col(value) * F.col(value)))).first()[0] or 0.0
            if norms is not None:
                norms.append(norm)
            if tol is not None and last is not None and abs(norm - last) <= tol * max(abs(norm), 1e-300):
                break
            last = norm
    return fs
