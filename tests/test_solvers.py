import numpy as np
import pytest
from pyspark.sql import functions as F

from cootensor import operators as op
from cootensor.plans import regression as reg
from cootensor.plans.solve import leading_eigvecs, ridge_solve
from cootensor.plans.tucker import hooi, random_factors, reconstruct, tucker_core
from conftest import from_dense, matrix_df, to_dense


def projector(f, k, d):
    m = np.zeros((k, d))
    for r in f.collect():
        m[r._1, r._2] = r.product
    return m.T @ m, m


def gapped_tensor(rng, shape, spectrum):
    """Tensor whose mode-1 unfolding has singular values ``spectrum``."""
    d = shape[0]
    rest = int(np.prod(shape[1:]))
    u, _ = np.linalg.qr(rng.standard_normal((d, d)))
    v, _ = np.linalg.qr(rng.standard_normal((rest, d)))
    s = np.zeros(d)
    s[:len(spectrum)] = spectrum
    return (u * s) @ v.T, u


@pytest.mark.parametrize("route", ["gram", "subspace"])
def test_leading_eigvecs_routes(spark, route):
    rng = np.random.default_rng(11)
    m, u = gapped_tensor(rng, (8, 6, 5), [10, 6, 3, 1, 0.5, 0.2])
    t = from_dense(spark, m.reshape(8, 6, 5))
    f = leading_eigvecs(op.unfold(t, "_1"), 2, route=route)
    p, rows = projector(f, 2, 8)
    want = u[:, :2] @ u[:, :2].T
    np.testing.assert_allclose(p, want, atol=1e-8)
    np.testing.assert_allclose(rows @ rows.T, np.eye(2), atol=1e-8)     # orthonormal rows
    for r in rows:                                                       # sign fixed
        assert r[np.argmax(np.abs(r))] > 0


def test_unconverged_solvers_raise(spark):
    rng = np.random.default_rng(2)
    m, _ = gapped_tensor(rng, (24, 5, 6), 0.99 ** np.arange(24))
    with pytest.raises(RuntimeError, match="not converged"):
        leading_eigvecs(op.unfold(from_dense(spark, m.reshape(24, 5, 6)), "_1"), 3, route="subspace", n_iter=6, oversample=1)
    h = 1.0 / (np.arange(8)[:, None] + np.arange(8)[None] + 1)
    with pytest.raises(RuntimeError, match="conjugate gradients"):
        ridge_solve(matrix_df(spark, h), matrix_df(spark, np.ones((1, 8))), route="cg", max_iter=4).count()


def spd_system(rng, n, ny):
    a = rng.standard_normal((n, n))
    a = a @ a.T + n * np.eye(n)
    c = rng.standard_normal((ny, n))
    return a, c


@pytest.mark.parametrize("route", ["local", "cg"])
def test_ridge_solve_routes(spark, route):
    rng = np.random.default_rng(2)
    a, c = spd_system(rng, 6, 3)
    b = ridge_solve(matrix_df(spark, a), matrix_df(spark, c), route=route)
    got = to_dense(b, (3, 6), ["_1", "_2"])
    np.testing.assert_allclose(got, np.linalg.solve(a, c.T).T, rtol=1e-8, atol=1e-10)


def test_ridge_local_splits_targets(spark):
    from cootensor.plans.solve import ridge_solve_local
    rng = np.random.default_rng(6)
    a, c = spd_system(rng, 5, 7)
    b = ridge_solve_local(matrix_df(spark, a), matrix_df(spark, c), targets=3)
    np.testing.assert_allclose(to_dense(b, (7, 5), ["_1", "_2"]), np.linalg.solve(a, c.T).T, rtol=1e-8, atol=1e-10)


def test_regression_of_a_mode_of_5000_indices(spark):
    """Beyond one Gram tile: the step runs and its factor fits like the dense solve."""
    rng = np.random.default_rng(8)
    src = np.sort(rng.choice(5000, 12, replace=False))
    src[-1] = 4999
    x = rng.integers(1, 6, size=(12, 5)).astype(float)
    y = rng.integers(1, 6, size=(2, 5)).astype(float)
    tx = spark.createDataFrame([(int(s), h, float(x[i, h])) for i, s in enumerate(src) for h in range(5)], "a int, h int, product double")
    ty = from_dense(spark, y, ["a", "h"])
    b, _ = reg.regression_step(tx, ty, [None], 0, precision=None)
    got = to_dense(b, (2, 5001), ["_1", "_2"])
    z = np.vstack([np.ones(5), x])                      # the other 4,988 sources have no cells, hence weight 0
    want = np.linalg.solve(z @ z.T + 0.001 * np.eye(13), z @ y.T).T
    np.testing.assert_allclose(got[:, np.concatenate(([0], src + 1))], want, rtol=1e-5, atol=1e-7)
    assert np.count_nonzero(got) == np.count_nonzero(want)


def test_regression_step_solves_normal_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(1, 6, size=(3, 2, 7)).astype(float)        # modes a, b, free h
    y = rng.integers(1, 6, size=(2, 2, 7)).astype(float)
    tx = from_dense(spark, x, ["a", "b", "h"])
    ty = from_dense(spark, y, ["a", "b", "h"])
    b_b = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (1, 0, 0.0), (1, 2, 1.0)],
                                "_1 int, _2 int, product double")   # identity on mode b
    bs = [None, b_b]
    b_a, _ = reg.regression_step(tx, ty, bs, 0, precision=None, route="local")
    got = to_dense(b_a, (2, 4), ["_1", "_2"])
    # dense reference: X̄ = X (mode b identity, zero bias); A = [[n, s'], [s, XX']] + 0.001 I
    xm = x.reshape(3, -1)
    ym = y.reshape(2, -1)
    n = 2 * 7                                                    # dense count of other target modes
    s = xm.sum(axis=1)
    A = np.zeros((4, 4))
    A[0, 0] = n
    A[0, 1:] = s
    A[1:, 0] = s
    A[1:, 1:] = xm @ xm.T
    A += 0.001 * np.eye(4)
    C = np.hstack([ym.sum(axis=1)[:, None], ym @ xm.T])
    want = np.linalg.solve(A, C.T).T
    np.testing.assert_allclose(got, want, rtol=1e-9)
    np.testing.assert_allclose(want @ A - C, 0, atol=1e-8)


def test_fit_runs_and_scores(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(1, 6, size=(3, 2, 9)).astype(float)
    y = 2 * x[:2] + 1
    tx = from_dense(spark, x, ["a", "b", "h"])
    ty = from_dense(spark, y, ["a", "b", "h"])
    init = reg.random_reg_factors(tx, ty, seed=1)
    bs, scores = reg.fit(tx, ty, init, n_iter=2, precision=None)
    assert len(bs) == 2 and len(scores) == 2
    assert scores[-1] is not None and scores[-1] > 0.9


def test_svd_init_factor_shape(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(1, 6, size=(4, 3, 5)).astype(float)
    y = rng.integers(1, 6, size=(2, 3, 5)).astype(float)
    f = reg.svd_init_factors(from_dense(spark, x, ["a", "b", "h"]), from_dense(spark, y, ["a", "b", "h"]))
    rows = f[0].collect()
    assert max(r._1 for r in rows) == 1                          # target rows 0..max
    assert {(r._1, r._2) for r in rows if r._2 == 0} == {(0, 0), (1, 0)}
    assert all(r.product >= 0 for r in rows)


def test_hooi_exact_low_rank_reconstructs(spark):
    rng = np.random.default_rng(12)
    g = rng.standard_normal((2, 2, 2))
    us = [np.linalg.qr(rng.standard_normal((d, 2)))[0] for d in (5, 4, 6)]
    a = np.einsum("abc,ia,jb,kc->ijk", g, *us)
    t = from_dense(spark, a)
    f0 = random_factors(t, [2, 2, 2], seed=3)
    fs = hooi(t, f0, n_iter=2)
    for f, u, d in zip(fs, us, (5, 4, 6)):
        p, _ = projector(f, 2, d)
        np.testing.assert_allclose(p, u @ u.T, atol=1e-8)
    rec = reconstruct(tucker_core(t, fs), fs)
    assert op.mse(t, rec).first().mse < 1e-20


def test_random_factors_are_reproducible(spark):
    t = spark.createDataFrame([(2, 3, 1.0)], "a int, b int, product double")
    f1 = sorted(random_factors(t, [2, 2], seed=4)[0].collect())
    f2 = sorted(random_factors(t.repartition(3), [2, 2], seed=4)[0].collect())
    assert f1 == f2 and len(f1) == 6
    assert all(0 <= r.product < 1 for r in f1)


def test_hooi_reuse_matches_plain_chain(spark):
    rng = np.random.default_rng(14)
    a = rng.integers(0, 4, size=(6, 5, 4, 3)).astype(float)
    t = from_dense(spark, a)
    f0 = random_factors(t, [2, 2, 2, 2], seed=6)
    fa = hooi(t, f0, n_iter=2, reuse=True)
    fb = hooi(t, f0, n_iter=2, reuse=False)
    for x, y, d in zip(fa, fb, (6, 5, 4, 3)):
        pa, _ = projector(x, 2, d)
        pb, _ = projector(y, 2, d)
        np.testing.assert_allclose(pa, pb, atol=1e-9)


def _np_affine(x, b, axis):
    """Dense affine mode product: W x_axis X + bias (every cell present)."""
    w, bias = b[:, 1:], b[:, 0]
    out = np.moveaxis(np.tensordot(w, np.moveaxis(x, axis, 0), axes=(1, 0)), 0, axis)
    shape = [1] * x.ndim
    shape[axis] = -1
    return out + bias.reshape(shape)


def _np_als(x, y, bs, sweeps, ridge=1e-3):
    bs = [b.copy() for b in bs]
    nmodes = len(bs)
    for _ in range(sweeps):
        prefix = x
        for i in range(nmodes):
            xbar = prefix
            for j in range(i + 1, nmodes):
                xbar = _np_affine(xbar, bs[j], j)
            m = np.moveaxis(xbar, i, 0).reshape(xbar.shape[i], -1)
            yk = np.moveaxis(y, i, 0).reshape(y.shape[i], -1)
            n = np.prod([y.shape[k] for k in range(y.ndim) if k != i])
            d = m.shape[0]
            a = np.zeros((d + 1, d + 1))
            a[0, 0] = n
            a[0, 1:] = a[1:, 0] = m.sum(axis=1)
            a[1:, 1:] = m @ m.T
            a += ridge * np.eye(d + 1)
            c = np.hstack([yk.sum(axis=1)[:, None], yk @ m.T])
            bs[i] = np.linalg.solve(a, c.T).T
            prefix = _np_affine(prefix, bs[i], i)
    return bs


def test_fit_two_sweeps_matches_numpy_als(spark):
    rng = np.random.default_rng(31)
    x = rng.uniform(1, 3, size=(3, 4, 6))             # modes a, b, free h; every cell stored
    y = rng.uniform(1, 3, size=(2, 3, 6))
    b0 = [rng.uniform(0.1, 1, size=(2, 4)), rng.uniform(0.1, 1, size=(3, 5))]
    tx = from_dense(spark, x, ["a", "b", "h"])
    ty = from_dense(spark, y, ["a", "b", "h"])

    def fdf(b):
        return spark.createDataFrame([(i, j, float(b[i, j])) for i in range(b.shape[0])
                                      for j in range(b.shape[1])], "_1 int, _2 int, product double")

    got, _ = reg.fit(tx, ty, [fdf(b) for b in b0], n_iter=2, precision=None)
    want = _np_als(x, y, b0, 2)
    for g, w in zip(got, want):
        np.testing.assert_allclose(to_dense(g, w.shape, ["_1", "_2"]), w, rtol=1e-7, atol=1e-9)


def test_svd_init_factors_match_numpy(spark):
    rng = np.random.default_rng(41)
    x = rng.uniform(1, 3, size=(4, 3, 5))
    y = rng.uniform(1, 3, size=(2, 3, 5))
    tx = from_dense(spark, x, ["a", "b", "h"])
    ty = from_dense(spark, y, ["a", "b", "h"])
    got = reg.svd_init_factors(tx, ty, precision=1e-3)
    for i, f in enumerate(got):
        m = np.moveaxis(x, i, 0).reshape(x.shape[i], -1)
        w, v = np.linalg.eigh(m @ m.T)
        u = np.abs(v[:, np.argsort(-w)])                   # columns = components, largest first
        tmax = y.shape[i] - 1
        want = {(t, j + 1): u[t, j] for t in range(min(tmax + 1, u.shape[0]))
                for j in range(u.shape[1]) if u[t, j] > 1e-3}
        want.update({(t, 0): 0.0 for t in range(tmax + 1)})
        have = {(r._1, r._2): r.product for r in f.collect()}
        assert set(have) == set(want)
        for key, val in want.items():
            assert abs(have[key] - val) < 1e-9


def test_hooi_core_norm_never_falls(spark):
    rng = np.random.default_rng(17)
    a = rng.integers(0, 5, size=(6, 5, 4)).astype(float)
    t = from_dense(spark, a)
    norms = []
    hooi(t, random_factors(t, [2, 2, 2], seed=8), n_iter=4, norms=norms)
    assert len(norms) == 4
    assert all(b >= a_ - 1e-9 * abs(a_) for a_, b in zip(norms, norms[1:])), norms
    assert norms[-1] <= np.linalg.norm(a) + 1e-9                      # projection never exceeds ||T||
