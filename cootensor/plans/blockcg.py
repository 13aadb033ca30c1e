"""Block conjugate gradients on DataFrames: many right-hand sides share one Krylov space.

Solves ``B A = C`` for symmetric positive definite A.  ``WIDTH`` targets (rows
of C) form a block; a block's state is one row per index it has reached, with
``WIDTH`` columns each for the solution x, residual r and direction p.  An index
a block has not reached has no row, so there is no index x target grid: a block
only holds what A connects to its right-hand sides.  One step

  q = A p,  alpha = (pᵀq)⁺ pᵀr,  x += p alpha,  r -= q alpha,
  z = D⁻¹ r,  beta = -(pᵀq)⁺ qᵀz,  p = z + p beta

takes the products of A (joins and sums, see the two operators below), sums of
``WIDTH x WIDTH`` products per block, and small solves inside tasks, one row per
block.  The pseudo-inverse drops directions that are dependent (targets that
are equal, zero or already solved), which is the deflation block methods need.

A is an *operator*: ``MatrixOperator`` multiplies by a stored matrix,
``NormalOperator`` by the augmented normal matrix of a regression without ever
forming it: two sparse products with the unfolding, so nothing of size d² exists.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, VALUE
from ..sources.runstore import RunStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 6            # targets of one block
_RANK_TOL = 1e-10    # eigenvalues of the scaled pᵀAp below this share of the largest are dropped
CYCLE_GAIN = 1e-6    # a cycle ends when the residual has fallen by this much; rounding has grown by then
PATIENCE = 12        # ... or after so many steps that do not halve it
CYCLES = 8
_CELLS = range(WIDTH * WIDTH)


def _wide(name: str) -> list[str]:
    return [f"{name}{c}" for c in range(WIDTH)]


def _products(entries: DataFrame, vectors: DataFrame, on: str, to: str, weight: str) -> DataFrame:
    """Terms ``(to, g, p..)`` of the product of a sparse matrix with the blocks' vectors."""
    return entries.join(vectors, on).selectExpr(to, "g", *_each(f"{weight} * p# AS p#"))


def _summed(terms: DataFrame, by: str, name: str) -> DataFrame:
    return terms.groupBy(by, "g").agg(*map(F.expr, _each(f"sum(p#) AS {name}#")))


class MatrixOperator:
    """A stored symmetric matrix ``(_1, _2, value)``."""

    def __init__(self, a: DataFrame, store: RunStore):
        self.a = store.cut(a.select(F.col("_1").cast("long").alias("i"), F.col("_2").cast("long").alias("s"),
                                    F.col(VALUE).cast("double").alias("a")), "matrix")

    def diagonal(self) -> DataFrame:
        return self.a.where("i = s").groupBy("s").agg(F.sum("a").alias("dg"))

    def apply(self, p: DataFrame) -> DataFrame:
        return _summed(_products(self.a, p, "s", "i", "a"), "i", "q").withColumnRenamed("i", "s")


class NormalOperator:
    """``[[n, sᵀ], [s, U Uᵀ]] + ridge I`` of an unfolding U ``(key, index, value)``, never formed.

    Index 0 is the bias, index j + 1 row j of U, s the row sums.  With a row of
    ones over the fibers U holds as row 0, the matrix is ``U Uᵀ + ridge I`` and,
    at the bias, the difference between the dense count ``n`` and those fibers.
    """

    def __init__(self, u: DataFrame, n: float, ridge: float, store: RunStore):
        key, idx, val = u.columns[:3]
        # cells that stand twice in a fiber add up, as they do in a stored Gram
        cells = u.where(F.col(idx).isNotNull() & F.col(val).isNotNull()) \
            .groupBy(F.col(key).alias("key"), (F.col(idx) + 1).cast("long").alias("s")).agg(F.sum(F.col(val).cast("double")).alias("v"))
        cells = store.cut(cells, "unfolding")
        ones = cells.select("key").distinct().select("key", F.lit(0).cast("long").alias("s"), F.lit(1.0).alias("v"))
        self.u = store.cut(cells.unionByName(ones), "augmented")
        self.n, self.ridge = float(n), float(ridge)
        self.unseen = self.n - ones.count()

    def _extra(self) -> Column:
        """What a diagonal cell has beyond ``U Uᵀ``."""
        return F.lit(self.ridge) + F.when(F.col("s") == 0, F.lit(self.unseen)).otherwise(F.lit(0.0))

    def diagonal(self) -> DataFrame:
        """No scaling: right-hand sides ``Y Uᵀ`` lie in the range of U and so do all directions then.

        Scaled directions would leave it, and with more indices than fibers the ridge
        alone would hold them, which costs as many digits as ridge is small.
        """
        bias = self.u.sparkSession.range(1).select(F.col("id").alias("s"))
        return self.u.select("s").unionByName(bias).distinct().withColumn("dg", F.lit(1.0))

    def apply(self, p: DataFrame) -> DataFrame:
        z = _summed(_products(self.u, p, "s", "key", "v"), "key", "p")
        own = p.withColumn("extra", self._extra()).selectExpr("s", "g", *_each("extra * p# AS p#"))
        return _summed(_products(self.u, z, "key", "s", "v").unionByName(own), "s", "q")


def _pinv(m: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a positive semidefinite matrix, after scaling its diagonal to 1."""
    m = (m + m.T) / 2
    d = np.sqrt(np.maximum(np.diag(m), 0.0))
    ok = d > 0
    inv = np.divide(1.0, d, out=np.zeros_like(d), where=ok)
    w, v = np.linalg.eigh(m * inv[:, None] * inv[None, :])
    use = w > _RANK_TOL * max(w.max(initial=0.0), 1e-300)
    core = (v[:, use] / w[use]) @ v[:, use].T
    return core * inv[:, None] * inv[None, :]


def _square(row, name: str) -> np.ndarray:
    return np.array([getattr(row, f"{name}{k}") for k in _CELLS], float).reshape(WIDTH, WIDTH)


def _alphas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            inv = _pinv(_square(r, "pq"))
            out.append((r.g, (inv @ _square(r, "pr")).ravel().tolist(), inv.ravel().tolist()))
        yield pd.DataFrame(out, columns=["g", "alpha", "inv"])


def _betas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            beta = -np.array(r.inv, float).reshape(WIDTH, WIDTH) @ _square(r, "qz")
            shares = [getattr(r, f"rr{k}") / getattr(r, f"bb{k}") for k in range(WIDTH) if getattr(r, f"bb{k}") > 0]
            out.append((r.g, beta.ravel().tolist(), max(shares, default=0.0) ** 0.5))
        yield pd.DataFrame(out, columns=["g", "beta", "rest"])


def _times(rows: str, matrix: str, c: int) -> str:
    """Column ``c`` of the row vector ``rows`` times the block's small matrix."""
    return "(" + " + ".join(f"{rows}{k} * {matrix}[{k * WIDTH + c}]" for k in range(WIDTH)) + ")"


def _outer(a: str, b: str, name: str, scale: str = "") -> list[Column]:
    return [F.expr(f"sum({a}{k // WIDTH} * {b}{k % WIDTH}{scale}) AS {name}{k}") for k in _CELLS]


def _each(form: str) -> list[str]:
    """One SQL expression per column of a block; ``#`` stands for its number."""
    return [form.replace("#", str(k)) for k in range(WIDTH)]


def _rhs(c: DataFrame) -> DataFrame:
    """Right-hand sides ``(s, g, r..)``: row t of C is column t % WIDTH of block t div WIDTH."""
    at = _each(f"sum(CASE WHEN _1 % {WIDTH} = # THEN {VALUE} ELSE 0D END) AS r#")
    return c.groupBy(F.col("_2").cast("long").alias("s"), F.expr(f"_1 div {WIDTH}").cast("long").alias("g")).agg(*map(F.expr, at))


def block_cg(op: MatrixOperator | NormalOperator, c: DataFrame, store: RunStore, tol: float = 1e-12, accept: float = 1e-8,
             max_steps: int | None = None, steps: list | None = None) -> DataFrame:
    """``B`` with ``B A = C`` as ``(_1 = target, _2 = index, value)``, zeros absent.

    Runs in cycles: after a fall of the residual by ``CYCLE_GAIN`` the true residual
    ``C - B A`` is taken and the next cycle starts from it, so rounding does not build
    up in ill-conditioned systems.  Ends when every target's true residual is at most
    ``tol`` of its right-hand side, or no longer falls and is at most ``accept``;
    raises otherwise.  ``steps`` collects the number of steps taken.
    """
    diag = store.cut(op.diagonal(), "diagonal")
    size = diag.count()
    near = F.broadcast if size <= BROADCAST_MAX_ROWS else (lambda d: d)       # two numbers a row
    b = store.cut(_rhs(c.select("_1", "_2", VALUE)), "rhs")
    norms = store.cut(b.groupBy("g").agg(*map(F.expr, _each("sum(r# * r#) AS bb#"))), "norms")
    small = norms.count() * (2 * WIDTH * WIDTH + 2) * 8 <= BROADCAST_MAX_BYTES
    per_block = F.broadcast if small else (lambda d: d)
    limit = max_steps or 2 * size + 10
    # indices outside A carry no equation: their diagonal is null and the check below reports them
    state = b.join(near(diag), "s", "left").selectExpr("s", "g", "dg", *_each("0D AS x#"), *_wide("r"))
    if state.where(F.col("dg").isNull() | (F.col("dg") <= 0)).limit(1).count():
        raise ValueError("the matrix has no positive diagonal at an index of the right-hand sides")
    taken, worst = 0, 1.0        # before the first step the residual is the right-hand side
    for _ in range(CYCLES):
        state = state.selectExpr("s", "g", "dg", *_wide("x"), *_wide("r"), *_each("r# / dg AS p#"))
        start = best = worst
        idle, old = 0, store.mark()
        while worst > max(tol, CYCLE_GAIN * start) and taken < limit and idle < PATIENCE:
            here = store.mark()
            state, worst = _step(op, state, diag, near, norms, per_block, store)
            store.drop_cuts(old, here)               # the step before: this one has its own files
            taken, old = taken + 1, here
            idle = 0 if worst < best / 2 else idle + 1
            best = min(best, worst)
        state, worst = _refreshed(op, state, b, diag, near, norms, per_block, store)
        store.drop_cuts(old, store.mark() - 1)
        if worst <= tol or taken >= limit or worst <= accept and worst > start / 10:
            break
    if steps is not None:
        steps.append(taken)
    if worst > accept:
        raise RuntimeError(f"block conjugate gradients: relative residual {worst:.3g} after {taken} steps (accepted: {accept:g})")
    cells = ", ".join(_each(f"struct(CAST(g * {WIDTH} + # AS int) AS _1, CAST(s AS int) AS _2, x# AS {VALUE})"))
    return state.select(F.expr(f"inline(array({cells}))")).where(F.col(VALUE) != 0)


def _worst(state: DataFrame, norms: DataFrame, per_block) -> float:
    """Largest residual of a target, relative to its right-hand side."""
    rr = state.groupBy("g").agg(*map(F.expr, _each("sum(r# * r#) AS rr#")))
    share = ", ".join(_each("coalesce(try_divide(rr#, bb#), 0D)"))
    return float((rr.join(per_block(norms), "g").agg(F.expr(f"max(greatest({share}))")).first()[0] or 0.0) ** 0.5)


def _with(state: DataFrame, q: DataFrame, diag: DataFrame, near) -> DataFrame:
    """State rows joined with product rows; an index reached for the first time gets a row of zeros."""
    q = q.join(near(diag).withColumnRenamed("dg", "dq"), "s")
    j = state.join(q, ["s", "g"], "full")
    cols = [c for c in state.columns if c not in ("s", "g", "dg")] + _wide("q")
    return j.selectExpr("s", "g", "coalesce(dg, dq) AS dg", *[f"coalesce({c}, 0D) AS {c}" for c in cols])


def _step(op, state: DataFrame, diag: DataFrame, near, norms: DataFrame, per_block, store: RunStore) -> tuple[DataFrame, float]:
    """One block step and the largest residual after it; the state is cut once, small matrices twice."""
    moving = " OR ".join(f"p{k} <> 0" for k in range(WIDTH))
    t = store.cut(_with(state, op.apply(state.where(moving).select("s", "g", *_wide("p"))), diag, near), "state")
    sums = t.groupBy("g").agg(*_outer("p", "q", "pq"), *_outer("p", "r", "pr"))
    alpha = store.cut(sums.mapInPandas(_alphas, "g long, alpha array<double>, inv array<double>"), "alpha")
    moved = t.join(per_block(alpha.drop("inv")), "g").selectExpr(
        "s", "g", "dg", *_wide("p"), *_wide("q"),
        *[f"x{k} + {_times('p', 'alpha', k)} AS x{k}" for k in range(WIDTH)],
        *[f"r{k} - {_times('q', 'alpha', k)} AS r{k}" for k in range(WIDTH)])
    qz = moved.groupBy("g").agg(*_outer("q", "r", "qz", " / dg"), *map(F.expr, _each("sum(r# * r#) AS rr#")))
    qz = qz.join(per_block(alpha.drop("alpha")), "g").join(per_block(norms), "g")
    beta = store.cut(qz.mapInPandas(_betas, "g long, beta array<double>, rest double"), "beta")
    worst = float(beta.agg(F.max("rest")).first()[0] or 0.0)
    state = moved.join(per_block(beta.drop("rest")), "g").selectExpr(
        "s", "g", "dg", *_wide("x"), *_wide("r"), *[f"r{k} / dg + {_times('p', 'beta', k)} AS p{k}" for k in range(WIDTH)])
    return state, worst


def _refreshed(op, state: DataFrame, b: DataFrame, diag: DataFrame, near, norms: DataFrame, per_block, store: RunStore):
    """State with the true residual ``C - B A``, and its largest relative size."""
    state = store.cut(state.select("s", "g", "dg", *_wide("x")), "solution")
    q = op.apply(state.selectExpr("s", "g", *_each("x# AS p#")))
    t = _with(state, q, diag, near).join(b, ["s", "g"], "left")
    t = store.cut(t.selectExpr("s", "g", "dg", *_wide("x"), *_each("coalesce(r#, 0D) - q# AS r#")), "residual")
    return t, _worst(t, norms, per_block)
