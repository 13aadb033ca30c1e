"""Tensor-on-tensor ridge regression by alternating least squares.

X and Y share their mode names; the last mode is the free (observation)
dimension and is never contracted.  Factor i is a regression matrix B_i
(``_1`` = target index, ``_2 = 0`` bias, ``_2 = j + 1`` source index j).

One update of mode i (S11-S13):
  X̄ = X with every other factor applied (updated ones for modes < i, held in
       ``prefix``; old ones for modes > i), threshold before bias;
  A = [[n, sᵀ], [s, X̄X̄ᵀ]] + ridge·I   (s = mode marginal of X̄, n = dense
       count of the other target modes including the free one);
  C = [Y·1, Y X̄ᵀ];  B_i = C A⁻¹ (solved, never inverted);
  prefix ← prefix ×_i B_i.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import ALS_SWEEPS, FIT_MIN_PRED, FIT_PRECISION, INIT_PRECISION, RIDGE
from ..functions.expr import hash_uniform, lcg_uniform
from ..operators.affine import affine_chain, affine_ttm, predict
from ..operators.algebra import cross_moment, gram, matrix_add, mode_marginal
from ..operators.metrics import r2
from ..operators.reshape import unfold
from ..session import VALUE
from ..tensor import modes_of
from ..sources.runstore import RunStore
from .blockcg import NormalOperator, block_cg
from .rangefinder import RANGE_TOL, range_vectors
from .solve import ridge_solve


def _m(df, c1, c2, v):
    return df.select(F.col(c1).cast("int").alias("_1"), F.col(c2).cast("int").alias("_2"),
                     F.col(v).cast("double").alias(VALUE))


def dense_count(y: DataFrame, mode: str, value: str = VALUE) -> DataFrame:
    """One row ``n``: product of ``max + 1`` over every mode of Y but ``mode``
    (free mode included, S12), as a double (D12)."""
    others = [m for m in modes_of(y, value) if m != mode]
    if not others:
        return y.agg(F.lit(1.0).alias("n"))
    return y.agg(reduce(lambda a, b: a * b, [(F.max(m) + 1).cast("double") for m in others]).alias("n"))


def normal_equations(xbar: DataFrame, mode: str, n: DataFrame, ridge: float = RIDGE,
                     value: str = VALUE) -> DataFrame:
    """Augmented normal matrix A (J4): Gram shifted by one, the marginal as
    row/column 0, the dense count at (0, 0), ``ridge`` on the diagonal
    0..d inclusive (the bias too, S13), where d = max source index + 1."""
    u = unfold(xbar, mode, value)
    xx = gram(u).select((F.col("_1") + 1).alias("_1"), (F.col("_2") + 1).alias("_2"), VALUE)
    s = mode_marginal(xbar, mode, value)
    row = _m(s.select((F.col(mode) + 1).alias("a"), F.lit(0).alias("b"), F.col(value)), "a", "b", value)
    col = row.select(F.col("_2").alias("_1"), F.col("_1").alias("_2"), VALUE)
    cnt = n.select(F.lit(0).alias("_1"), F.lit(0).alias("_2"), F.col("n").alias(VALUE))
    diag = xbar.agg((F.max(mode) + 1).alias("__d")).select(
        F.explode(F.sequence(F.lit(0), F.col("__d"))).alias("_1")).select(
        "_1", F.col("_1").alias("_2"), F.lit(float(ridge)).alias(VALUE))
    return matrix_add(xx, row, col, _m(cnt, "_1", "_2", VALUE), diag)


def cross_moments(y: DataFrame, xbar: DataFrame, mode: str, value: str = VALUE) -> DataFrame:
    """C = [Y·1, Y X̄ᵀ] (J5): target x (source + 1), bias column 0."""
    yx = cross_moment(unfold(y, mode, value), unfold(xbar, mode, value))
    yx = yx.select("_1", (F.col("_2") + 1).alias("_2"), VALUE)
    ysum = mode_marginal(y, mode, value).select(F.col(mode).cast("int").alias("_1"),
                                                F.lit(0).alias("_2"), F.col(value).alias(VALUE))
    return yx.unionByName(ysum)


def regression_step(x: DataFrame, y: DataFrame, bs: list[DataFrame], i: int,
                    prefix: DataFrame | None = None, precision: float | None = FIT_PRECISION,
                    ridge: float = RIDGE, route: str = "matrix_free", value: str = VALUE,
                    checkpoint: bool = True, checkpoint_inputs: bool = False) -> tuple[DataFrame, DataFrame]:
    """Update factor ``i`` (J7).  Returns ``(B_i, new prefix)``.

    ``route="matrix_free"`` solves by block conjugate gradients on the unfolding
    and never forms the normal matrix, whatever its size; ``"local"`` forms it and
    solves in one task per block of targets (d <= MAX_LOCAL_DIM), ``"cg"`` forms it
    and iterates on it.
    """
    if checkpoint_inputs:
        x, y = x.checkpoint(eager=True), y.checkpoint(eager=True)
        prefix = prefix.checkpoint(eager=True) if prefix is not None else None
    modes = modes_of(x, value)
    mode = modes[i]
    base = prefix if prefix is not None else x
    xbar = affine_chain(x, bs, skip=i, precision=precision, prefix=base, value=value)
    if checkpoint:
        xbar = xbar.checkpoint(eager=True)
    c = cross_moments(y, xbar, mode, value)
    n = dense_count(y, mode, value)
    if route == "matrix_free":
        work = RunStore(x.sparkSession)
        normal = NormalOperator(unfold(xbar, mode, value), n.first()["n"] or 0.0, ridge, work)
        b = block_cg(normal, c, work)
    else:
        b = ridge_solve(normal_equations(xbar, mode, n, ridge, value), c, route=route).filter(F.abs(F.col(VALUE)) > 0)
    if checkpoint:
        b = b.checkpoint(eager=True)
        if route == "matrix_free":
            work.drop()                  # the solver's files: the factor has its own copy
    new_prefix = affine_ttm(base, b, mode, precision, "before", value)
    if checkpoint:
        new_prefix = new_prefix.checkpoint(eager=True)
    return b, new_prefix


def fit(x: DataFrame, y: DataFrame, bs: list[DataFrame], n_iter: int = ALS_SWEEPS,
        precision: float | None = FIT_PRECISION, ridge: float = RIDGE, route: str = "matrix_free", store=None, tol: float | None = None,
        value: str = VALUE) -> tuple[list[DataFrame], list[float]]:
    """ALS fit (J8): ``n_iter`` sweeps over the non-free modes; after every
    sweep the model predicts X and is scored with R² (prediction >= 1 kept,
    then > 0, S20).  Factors and scores go to ``store`` (a ``RunStore``)
    when given.  ``tol`` stops once R² moves less than ``tol``.

    A store that already holds committed entries (a run that was stopped) is gone on
    with: its factors and scores are read back, and the first update is the one after
    the last committed.  Start it with the same inputs and arguments."""
    bs = list(bs)
    scores = []
    done = store.committed() if store is not None else set()
    scored = store.committed("scores") if store is not None else set()
    # X and Y are read by every mode update: cut their lineage once
    x, y = x.checkpoint(eager=True), y.checkpoint(eager=True)
    for it in range(n_iter):
        prefix = None
        for i in range(len(bs)):
            if (it, i) in done:
                bs[i] = store.load_factor(it, i)
                if i + 1 < len(bs) and (it, i + 1) not in done:      # the next update needs the prefix up to here
                    for j in range(i + 1):
                        prefix = affine_ttm(x if prefix is None else prefix, bs[j], modes_of(x, value)[j], precision, "before", value)
                    prefix = prefix.checkpoint(eager=True)
                continue
            b, prefix = regression_step(x, y, bs, i, prefix, precision, ridge, route, value)
            bs[i] = store.save_factor(b, it, i) if store is not None else b
        if (it, 0) in scored:
            s = store.scores().where(F.col("iter") == it)
        else:
            s = r2(y, predict(x, bs, precision, value), min_pred=FIT_MIN_PRED, value=value)
            if store is not None:
                store.save_score(s, it)
        r = s.first()["r2"]
        scores.append(r)
        if tol is not None and len(scores) > 1 and r is not None and scores[-2] is not None \
                and abs(r - scores[-2]) < tol:
            break
    return bs, scores


def _reg_grid(x: DataFrame, y: DataFrame, mode: str) -> DataFrame:
    """Index grid target 0..max_t x source column 0..max_s + 1 (bias 0).

    The grid is dense by definition (S15); it is generated as one distributed
    ``range`` (div/mod decoded), sized from two scalar lookups, so no single
    task produces it.
    """
    from ..sources.io import index_grid
    tmax = y.agg(F.max(mode)).first()[0]
    smax = x.agg(F.max(mode)).first()[0]
    if tmax is None or smax is None:
        return x.sparkSession.createDataFrame([], "_1 int, _2 int")
    return index_grid(x.sparkSession, [int(tmax) + 1, int(smax) + 2], ["_1", "_2"])


def random_reg_factors(x: DataFrame, y: DataFrame, precision: float = INIT_PRECISION, seed: int = 0,
                       kind: str = "hash", value: str = VALUE) -> list[DataFrame]:
    """Random initial regression factors (I12, S15): full grid, uniform
    [0, 1), kept where ``abs > precision``.  ``kind="lcg"`` uses the
    SQL-reproducible integer generator."""
    modes = modes_of(y, value)[:-1]
    out = []
    for i, m in enumerate(modes):
        g = _reg_grid(x, y, m)
        u = hash_uniform(seed * 1009 + i, "_1", "_2") if kind == "hash" else lcg_uniform("_1", "_2", seed + i)
        out.append(g.select("_1", "_2", u.alias(VALUE)).filter(F.abs(F.col(VALUE)) > precision))
    return out


def svd_init_factors(x: DataFrame, y: DataFrame, precision: float = INIT_PRECISION, range_tol: float = RANGE_TOL,
                     value: str = VALUE) -> list[DataFrame]:
    """SVD initial regression factors (J2, S14): |u| of the left singular vectors
    of X's unfolding, rows up to the target's max index, entries above
    ``precision``, plus a zero bias for every target index.

    The rank is found by ``range_vectors``: components are taken until the rest
    of the unfolding is at most ``range_tol`` of its norm.  At the default those
    left out belong to eigenvalues of the Gram below 1e-12 of the largest, whose
    vectors are arbitrary.  Work and result follow the rank; the dimension has no limit.
    """
    modes = modes_of(y, value)[:-1]
    out = []
    for m in modes:
        vec, _ = range_vectors(unfold(x, m, value), range_tol)      # (_1 comp, _2 index)
        tmax = y.select(F.max(m)).scalar()
        w = vec.select(F.col("_2").alias("_1"), (F.col("_1") + 1).alias("_2"),
                       F.abs(F.col(VALUE)).alias(VALUE))
        w = w.filter((F.col("_1") <= tmax) & (F.col(VALUE) > precision))
        bias = y.agg(F.max(m).alias("__t")).select(
            F.explode(F.sequence(F.lit(0), F.col("__t"))).alias("_1")).select(
            "_1", F.lit(0).alias("_2"), F.lit(0.0).alias(VALUE))
        out.append(w.unionByName(bias))
    return out


def mode_residual(y: DataFrame, xbar: DataFrame, b: DataFrame, mode: str, value: str = VALUE) -> DataFrame:
    """Residual of one mode's regression (J11): ``y - (W·X̄ + bias)`` on the
    cells both hold, as a tensor with value ``residual``."""
    modes = modes_of(y, value)
    pred = affine_ttm(xbar, b, mode, precision=None, value=value)
    j = y.join(pred.withColumnRenamed(value, "__p"), modes)
    return j.select(*modes, (F.col(value) - F.col("__p")).alias("residual"))
