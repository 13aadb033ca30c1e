"""Leading eigenvectors (J1) and the ridge solve (J6), without a driver matrix.

Two routes each:

* **local**: for a mode dimension d <= ``max_local_dim`` the d x d matrix is
  built on Spark (bounded by d², not by the data) and solved by numpy inside
  one executor task (``applyInPandas`` on one constant group).
* **distributed**: the work is spmm joins over COO tables, only p x p (p =
  rank + oversampling) pieces meet in one task.  Eigenvectors by randomized
  subspace iteration with Cholesky-QR and a Rayleigh-Ritz step; ridge by
  block conjugate gradients (``plans/blockcg.py``).
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hash_uniform
from ..operators.algebra import gram
from ..operators.dense import fiber_gram
from ..sources.runstore import RunStore
from ..session import MAX_LOCAL_DIM, TILE_DIM, VALUE

# This module's functions run inside Python workers.  Ship them by value so a
# worker needs no copy of this package on its path (e.g. a driver started
# outside the repository, or executors without --py-files).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FACTOR_SCHEMA = "_1 int, _2 int, product double"


def _one_group(df: DataFrame) -> DataFrame:
    return df.withColumn("__g", F.lit(0))


def sign_fix(f: DataFrame) -> DataFrame:
    """Make the largest-magnitude entry of every factor row (``_1``) positive.

    ``max_by`` is a partial aggregate: a row of d entries never sits whole in
    one task.  The sign table has one row per component (bounded by the rank),
    so it is broadcast.
    """
    s = f.groupBy("_1").agg(F.max_by(VALUE, F.abs(F.col(VALUE))).alias("__piv"))
    s = s.select("_1", F.when(F.col("__piv") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("__s"))
    return f.join(F.broadcast(s), "_1").select("_1", "_2", (F.col(VALUE) * F.col("__s")).alias(VALUE))


def _eig_task(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"_1": [], "_2": [], VALUE: []})
        d = int(max(pdf["_1"].max(), pdf["_2"].max())) + 1
        g = np.zeros((d, d))
        g[pdf["_1"].to_numpy(), pdf["_2"].to_numpy()] = pdf[VALUE].to_numpy()
        w, v = np.linalg.eigh(g)
        order = np.argsort(-w)[:min(k, d)]
        v = v[:, order]
        kk, jj = np.meshgrid(np.arange(v.shape[1]), np.arange(d), indexing="ij")
        return pd.DataFrame({"_1": kk.ravel().astype(np.int32), "_2": jj.ravel().astype(np.int32),
                             VALUE: v.T.ravel()})
    return run


def eigvecs_of_gram(g: DataFrame, k: int) -> DataFrame:
    """Leading ``min(k, d)`` eigenvectors of a symmetric matrix as a factor
    ``(_1 = component, _2 = index, value)``, sign-fixed."""
    out = (_one_group(g.select("_1", "_2", VALUE)).groupBy("__g")
           .applyInPandas(lambda p: _eig_task(k)(p.drop(columns="__g")), _FACTOR_SCHEMA))
    return sign_fix(out)


def _qr_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """R⁻¹ from the Cholesky factor of the p x p Gram of W (as a factor that
    maps old column c to new column c')."""
    p = int(max(pdf["_1"].max(), pdf["_2"].max())) + 1
    s = np.zeros((p, p))
    s[pdf["_1"].to_numpy(), pdf["_2"].to_numpy()] = pdf[VALUE].to_numpy()
    s = s + np.eye(p) * (1e-12 * max(np.trace(s), 1e-300))
    r = np.linalg.cholesky(s).T          # S = Rᵀ R
    rinv = np.linalg.inv(r)              # Q = W R⁻¹
    new, old = np.meshgrid(np.arange(p), np.arange(p), indexing="ij")
    return pd.DataFrame({"_1": new.ravel().astype(np.int32), "_2": old.ravel().astype(np.int32),
                         VALUE: rinv[old.ravel(), new.ravel()]})


def _rr_task(k: int):
    """Rayleigh-Ritz: top-k eigenvectors of the p x p projected matrix, as a
    factor mapping subspace column c to component k."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(max(pdf["_1"].max(), pdf["_2"].max())) + 1
        b = np.zeros((p, p))
        b[pdf["_1"].to_numpy(), pdf["_2"].to_numpy()] = pdf[VALUE].to_numpy()
        w, v = np.linalg.eigh(b)
        order = np.argsort(-w)[:k]
        comp, c = np.meshgrid(np.arange(len(order)), np.arange(p), indexing="ij")
        return pd.DataFrame({"_1": comp.ravel().astype(np.int32), "_2": c.ravel().astype(np.int32),
                             VALUE: v[:, order][c.ravel(), comp.ravel()]})
    return run


def _apply_small(df: DataFrame, fn, cols=("_1", "_2", VALUE)) -> DataFrame:
    return (_one_group(df.select(*cols)).groupBy("__g")
            .applyInPandas(lambda p: fn(p.drop(columns="__g")), _FACTOR_SCHEMA))


def _project(u: DataFrame, q: DataFrame) -> DataFrame:
    """Z = Uᵀ Q per fiber: ``(key, c, z)``; Q is ``(j, c, q)`` (d x p, broadcast
    when its size is checked small, else shuffled)."""
    from ..operators.joins import sized_broadcast
    key, idx, val = u.columns[:3]
    qq = sized_broadcast(q.select(F.col("j").alias("__j"), "c", "q"))
    j = u.join(qq, u[idx] == qq["__j"])
    return j.groupBy(F.col(key).alias("key"), "c").agg(F.sum(F.col(val) * F.col("q")).alias("z"))


def _expand(u: DataFrame, z: DataFrame) -> DataFrame:
    """W = U Z: ``(j, c, w)``.  Every U entry meets at most p rows of Z.  Z
    has one row per (fiber, column); when it is small (few fibers, the usual
    case after projecting the other modes onto low ranks) it is broadcast, so
    a long fiber never becomes one skewed join partition."""
    from ..operators.joins import sized_broadcast
    key, idx, val = u.columns[:3]
    z = sized_broadcast(z.checkpoint(eager=True))
    j = u.select(F.col(key).alias("key"), F.col(idx).alias("j"), F.col(val).alias("v")).join(z, "key")
    return j.groupBy("j", "c").agg(F.sum(F.col("v") * F.col("z")).alias("w"))


def _orthonormalize(w: DataFrame) -> DataFrame:
    s = fiber_gram(w.select("j", "c", "w"), dim=TILE_DIM)       # p x p, Σ_j w_j w_jᵀ
    rinv = _apply_small(s, _qr_task)                              # (new, old, value)
    j = w.join(F.broadcast(rinv), w["c"] == rinv["_2"])
    return j.groupBy("j", F.col("_1").alias("c")).agg(F.sum(F.col("w") * F.col(VALUE)).alias("q"))


def subspace_eigvecs(u: DataFrame, k: int, n_iter: int = 300, oversample: int = 10,
                     seed: int = 0, checkpoint: bool = True, tol: float = 1e-11, check_every: int = 4) -> DataFrame:
    """Leading k left singular vectors of an unfolding ``(key, idx, value)``
    (eigenvectors of U Uᵀ) without forming U Uᵀ.

    Every ``check_every`` steps the Ritz vectors are compared with the last
    ones; the iteration ends when the space they span has turned by less than
    ``tol`` (share of the squared overlaps missing, per step) and raises when ``n_iter``
    steps do not get there.
    """
    key, idx, val = u.columns[:3]
    if checkpoint:
        u = u.checkpoint(eager=True)    # read twice per step: cut its lineage once
    ids = u.select(F.col(idx).alias("j")).distinct()
    p = max(1, min(k + oversample, ids.count()))     # no more directions than indices
    store = RunStore(u.sparkSession)                 # files keep true sizes; checkpoint estimates would square in every step
    q = ids.select("j", F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("c"))
    q = q.select("j", "c", (hash_uniform(seed, "j", "c") - F.lit(0.5)).alias("q"))
    q = _orthonormalize(q.withColumnRenamed("q", "w"))
    last = None
    for it in range(n_iter):
        w = _expand(u, _project(u, q))
        q = _orthonormalize(w)
        q = store.cut(q)
        if (it + 1) % check_every == 0:
            f = store.cut(_ritz(u, q, k))
            if last is not None:
                g = last.select(F.col("_1").alias("o"), "_2", F.col(VALUE).alias("w"))
                dots = f.join(g, "_2").groupBy("_1", "o").agg(F.sum(F.col(VALUE) * F.col("w")).alias("d"))
                both = dots.agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
                own = f.agg(F.sum(F.col(VALUE) * F.col(VALUE))).first()[0] or 0.0
                if own - both <= tol * own * check_every:
                    return sign_fix(f)
            last = f
    raise RuntimeError(f"subspace iteration has not converged in {n_iter} steps; raise oversample or n_iter")


def _ritz(u: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """The k leading Ritz vectors of U Uᵀ in the space of ``q``."""
    z = _project(u, q)
    b = fiber_gram(z.select("key", "c", "z"), dim=TILE_DIM)     # p x p = Zᵀ Z
    v = _apply_small(b, _rr_task(k))                               # (comp, c, value)
    j = q.join(F.broadcast(v), q["c"] == v["_2"])
    f = j.groupBy(F.col("_1"), F.col("j").alias("_2")).agg(F.sum(F.col("q") * F.col(VALUE)).alias(VALUE))
    return f.select(F.col("_1").cast("int"), F.col("_2").cast("int"), VALUE)


def jacobi_eigh(g: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (largest first) and eigenvectors (columns) of a positive semidefinite
    matrix by Jacobi rotations of disjoint pairs.  A Gram whose columns differ by orders
    of magnitude keeps its small eigenvectors, which ``eigh`` blurs by the largest eigenvalue."""
    n = len(g)
    a, v = g.astype(float), np.eye(n)
    ring = list(range(n)) + [-1] * (n % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(min(x, y), max(x, y)) for x, y in zip(ring[:len(ring) // 2], ring[::-1]) if x >= 0 and y >= 0]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            act = np.abs(apq) > 1e-16 * np.sqrt(np.abs(app * aqq))
            if not act.any():
                continue
            turned = True
            p, q, app, aqq, apq = p[act], q[act], app[act], aqq[act], apq[act]
            tau = (aqq - app) / (2 * apq)
            t = np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.hypot(1, tau))
            c = 1 / np.hypot(1, t)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
            v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    w = a.diagonal()
    order = np.argsort(-w, kind="stable")
    return w[order], v[:, order]


def _fiber_task(k: int):
    """Fiber weights v / sigma of the ``k`` leading components, as ``(component, fiber, weight)``;
    components below 1e-13 of the largest eigenvalue are rounding and left out."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["_1"].max(), pdf["_2"].max())) + 1
        g = np.zeros((n, n))
        g[pdf["_1"].to_numpy(), pdf["_2"].to_numpy()] = pdf[VALUE].to_numpy()
        w, v = jacobi_eigh((g + g.T) / 2)
        r = min(k, int((w > 1e-13 * w[0]).sum()))
        comp, f = np.meshgrid(np.arange(r), np.arange(n), indexing="ij")
        weight = v[:, :r] / np.sqrt(w[:r])
        return pd.DataFrame({"_1": comp.ravel().astype(np.int32), "_2": f.ravel().astype(np.int32), VALUE: weight.T.ravel()})
    return run


def fiber_eigvecs(u: DataFrame, k: int, sizes: list[int]) -> DataFrame | None:
    """Leading ``k`` left singular vectors of an unfolding with few fibers, whatever
    its number of indices: u = U v / sigma from the fibers' own Gram UᵀU.

    ``sizes`` are the index ranges of the modes in the key struct; their product, the
    number of fibers, is what one task holds squared.  None where the unfolding
    has fewer than ``k`` components.
    """
    key, idx, val = u.columns[:3]
    fiber = F.lit(0)
    for name, size in zip(u.schema[key].dataType.names, sizes):
        fiber = fiber * F.lit(int(size)) + u[key][name]
    e = u.select(F.col(idx).alias("j"), fiber.cast("int").alias("r"), F.col(val).alias("y"))
    g = fiber_gram(e, dim=int(np.prod(sizes)))
    m = _apply_small(g, _fiber_task(k)).checkpoint(eager=True)       # k x fibers
    if m.agg(F.max("_1")).first()[0] != k - 1:
        return None
    j = e.join(F.broadcast(m), e["r"] == m["_2"])
    f = j.groupBy("_1", F.col("j").alias("_2")).agg(F.sum(F.col("y") * F.col(VALUE)).alias(VALUE))
    return sign_fix(f.select(F.col("_1").cast("int"), F.col("_2").cast("int"), VALUE))


def leading_eigvecs(u: DataFrame, k: int, route: str = "auto", max_local_dim: int = MAX_LOCAL_DIM,
                    dim: int | None = None, **kw) -> DataFrame:
    """Leading ``k`` left singular vectors of the unfolding ``u`` (J1) as a
    factor ``(_1 = component, _2 = index, value)``.

    ``route="gram"`` builds U Uᵀ on Spark and solves it in one task (needs
    d <= max_local_dim); ``"subspace"`` never forms it; ``"auto"`` picks the
    Gram route when the index range is small enough.  Both give the same
    vectors to the subspace test's tolerance, or raise.
    """
    if route != "subspace":
        if dim is None:
            dim = (u.agg(F.max(u.columns[1])).first()[0] or 0) + 1
        if route == "gram" and dim > max_local_dim:
            raise ValueError(f"dimension {dim} > max_local_dim={max_local_dim}: use route='subspace'")
        if dim <= max_local_dim:
            return eigvecs_of_gram(gram(u), k)
    return subspace_eigvecs(u, k, **kw)


# ------------------------------------------------------------------ ridge

def _solve_task(pdf: pd.DataFrame) -> pd.DataFrame:
    a = pdf[pdf["__m"] == 0]
    c = pdf[pdf["__m"] == 1]
    n = int(max(a["_1"].max(), a["_2"].max(), c["_2"].max() if len(c) else 0)) + 1
    t0 = int(c["_1"].min()) if len(c) else 0        # first target of this block
    ny = int(c["_1"].max()) + 1 - t0 if len(c) else 0
    am = np.zeros((n, n))
    am[a["_1"].to_numpy(), a["_2"].to_numpy()] = a[VALUE].to_numpy()
    cm = np.zeros((ny, n))
    if len(c):
        cm[c["_1"].to_numpy() - t0, c["_2"].to_numpy()] = c[VALUE].to_numpy()
    # B A = C  <=>  A Bᵀ = Cᵀ  (A symmetric positive definite)
    b = np.linalg.solve(am, cm.T).T
    t, s = np.nonzero(b)
    return pd.DataFrame({"_1": (t + t0).astype(np.int32), "_2": s.astype(np.int32), VALUE: b[t, s]})


def ridge_solve_local(a: DataFrame, c: DataFrame, targets: int = TILE_DIM) -> DataFrame:
    """B = C A⁻¹, one task per block of ``targets`` rows of C.

    A is (d+1) x (d+1) with d <= max_local_dim and goes to every block, so a
    task holds A and ``targets`` right-hand sides however many targets C has.
    """
    last = c.select(F.max(F.expr(f"_1 div {int(targets)}"))).scalar()
    both = (a.select("_1", "_2", VALUE, F.lit(0).alias("__m"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("__g"))
            .unionByName(c.select("_1", "_2", VALUE, F.lit(1).alias("__m"), F.expr(f"_1 div {int(targets)}").alias("__g"))))
    return both.groupBy("__g").applyInPandas(lambda p: _solve_task(p.drop(columns="__g")), _FACTOR_SCHEMA)


def ridge_solve_cg(a: DataFrame, c: DataFrame, tol: float = 1e-12, max_iter: int | None = None, accept: float = 1e-8,
                   steps: list | None = None) -> DataFrame:
    """B = C A⁻¹ by block conjugate gradients on the stored matrix (``plans/blockcg.py``).

    Targets share Krylov blocks; only the indices a block reaches are held.  A
    relative residual above ``accept`` after the last step is an error.
    """
    from .blockcg import MatrixOperator, block_cg

    store = RunStore(a.sparkSession)
    return block_cg(MatrixOperator(a, store), c, store, tol, accept, max_iter, steps)


def ridge_solve(a: DataFrame, c: DataFrame, route: str = "cg", **kw) -> DataFrame:
    """Solve ``B A = C`` for B (J6).  A is the symmetric positive definite
    normal matrix, C the cross moments; no inverse is formed.

    ``route="cg"`` takes any dimension, ``"local"`` solves in one task per block
    of targets and needs a dimension of at most ``MAX_LOCAL_DIM`` + 1.  The caller
    chooses; no route is taken by size.
    """
    if route == "local":
        return ridge_solve_local(a, c)
    return ridge_solve_cg(a, c, **kw)
