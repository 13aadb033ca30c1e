import numpy as np
import pytest
from pyspark.sql import functions as F

from cootensor import operators as op
from conftest import from_dense, matrix_df, to_dense


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def sparse_tensor(rng, shape, density=0.5):
    a = rng.integers(-5, 6, size=shape).astype(float)
    a[rng.random(shape) > density] = 0
    return a


def test_ttm_matches_einsum(spark, rng):
    a = sparse_tensor(rng, (4, 5, 6))
    f = rng.integers(-3, 4, size=(3, 5)).astype(float)       # rank x dim of mode _2
    t = from_dense(spark, a)
    out = op.ttm(t, matrix_df(spark, f), "_2")
    assert out.columns == ["_1", "_2", "_3", "product"]
    np.testing.assert_allclose(to_dense(out, (4, 3, 6)), np.einsum("ijk,rj->irk", a, f))


@pytest.mark.parametrize("broadcast", [True, False, "auto"])
def test_ttm_join_strategies_agree(spark, rng, broadcast):
    a = sparse_tensor(rng, (3, 4, 5))
    f = rng.integers(1, 4, size=(2, 3)).astype(float)
    out = op.ttm(from_dense(spark, a), matrix_df(spark, f), "_1", broadcast=broadcast)
    np.testing.assert_allclose(to_dense(out, (2, 4, 5)), np.einsum("ijk,ri->rjk", a, f))


def test_chain_skip_surplus_and_none(spark, rng):
    a = sparse_tensor(rng, (3, 4, 5))
    f1, f2, f3 = (rng.integers(-2, 3, size=s).astype(float) for s in [(2, 3), (2, 4), (2, 5)])
    t = from_dense(spark, a)
    fs = [matrix_df(spark, f) for f in (f1, f2, f3)]
    full = op.ttm_chain(t, fs)
    np.testing.assert_allclose(to_dense(full, (2, 2, 2)), np.einsum("ijk,ai,bj,ck->abc", a, f1, f2, f3))
    skip = op.ttm_chain(t, fs, skip=1)
    np.testing.assert_allclose(to_dense(skip, (2, 4, 2)), np.einsum("ijk,ai,ck->ajc", a, f1, f3))
    # fewer factors than modes: surplus modes untouched; None skips a mode
    short = op.ttm_chain(t, [None, fs[1]])
    np.testing.assert_allclose(to_dense(short, (3, 2, 5)), np.einsum("ijk,bj->ibk", a, f2))


def test_chain_reorder_is_same_result(spark, rng):
    a = sparse_tensor(rng, (6, 5, 4))
    fs_np = [rng.integers(-2, 3, size=s).astype(float) for s in [(2, 6), (3, 5), (4, 4)]]
    t = from_dense(spark, a)
    fs = [matrix_df(spark, f) for f in fs_np]
    a1 = to_dense(op.ttm_chain(t, fs), (2, 3, 4))
    a2 = to_dense(op.ttm_chain(t, fs, reorder=True), (2, 3, 4))
    np.testing.assert_allclose(a1, a2)


def test_ttm_commutes_and_composes(spark, rng):
    a = sparse_tensor(rng, (3, 4, 5))
    t = from_dense(spark, a)
    f = rng.integers(-2, 3, size=(2, 3)).astype(float)
    g = rng.integers(-2, 3, size=(3, 5)).astype(float)
    h = rng.integers(-2, 3, size=(2, 2)).astype(float)
    x1 = op.ttm(op.ttm(t, matrix_df(spark, f), "_1"), matrix_df(spark, g), "_3")
    x2 = op.ttm(op.ttm(t, matrix_df(spark, g), "_3"), matrix_df(spark, f), "_1")
    np.testing.assert_allclose(to_dense(x1, (2, 4, 3)), to_dense(x2, (2, 4, 3)))
    # (T x F) x H = T x (H F) on one mode
    y1 = op.ttm(op.ttm(t, matrix_df(spark, f), "_1"), matrix_df(spark, h), "_1")
    y2 = op.ttm(t, matrix_df(spark, h @ f), "_1")
    np.testing.assert_allclose(to_dense(y1, (2, 4, 5)), to_dense(y2, (2, 4, 5)))


def test_spmm_both_orientations(spark, rng):
    a = sparse_tensor(rng, (4, 3))
    b = sparse_tensor(rng, (4, 5))
    c = sparse_tensor(rng, (6, 3))
    atb = op.spmm_atb(matrix_df(spark, a), matrix_df(spark, b))
    np.testing.assert_allclose(to_dense(atb, (3, 5), ["_1", "_2"]), a.T @ b)
    abt = op.spmm_abt(matrix_df(spark, a), matrix_df(spark, c))
    assert abt.columns == ["_1", "_1_r", "product"]          # distinct names (D10)
    np.testing.assert_allclose(to_dense(abt, (4, 6), ["_1", "_1_r"]), a @ c.T)


def test_spmm_string_and_struct_keys(spark):
    a = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 2.0), ("y", 1, 3.0)], "k string, i int, product double")
    b = spark.createDataFrame([("x", 0, 5.0), ("y", 0, 7.0)], "k string, j int, product double")
    got = {(r["_1"], r["_2"]): r["product"] for r in op.spmm_atb(a, b).collect()}
    assert got == {(0, 0): 5.0, (1, 0): 10.0 + 21.0}
    t = spark.createDataFrame([(0, 0, 1, 2.0), (0, 1, 1, 3.0), (1, 0, 0, 4.0)], "a int, b int, c int, product double")
    u = op.unfold(t, "c")                      # struct key (a, b)
    f = spark.createDataFrame([(0, 1, 10.0), (1, 0, 1.0)], "_1 int, _2 int, product double")
    r = op.spmm_abt(f, u)                      # contracts f._2 with u.c
    got = {(x["_1"], x["a+b"]["a"], x["a+b"]["b"]): x["product"] for x in r.collect()}
    assert got == {(0, 0, 0): 20.0, (0, 0, 1): 30.0, (1, 1, 0): 4.0}


@pytest.mark.parametrize("density", [0.05, 0.9])
def test_gram_dense_and_sparse_paths(spark, rng, density):
    a = sparse_tensor(rng, (7, 30, 4), density)
    t = from_dense(spark, a)
    g = op.gram(op.unfold(t, "_1"))
    m = a.reshape(7, -1)
    want = m @ m.T
    got = to_dense(g, (7, 7), ["_1", "_2"])
    np.testing.assert_allclose(got, want)
    assert np.allclose(got, got.T)
    assert np.linalg.eigvalsh(got).min() > -1e-9 * max(1, abs(want).max())


def test_cross_moment(spark, rng):
    a = sparse_tensor(rng, (3, 4, 5))
    b = sparse_tensor(rng, (2, 4, 5))
    ta = from_dense(spark, a)
    tb = from_dense(spark, b)
    c = op.cross_moment(op.unfold(ta, "_1"), op.unfold(tb, "_1"))
    np.testing.assert_allclose(to_dense(c, (3, 2), ["_1", "_2"]), a.reshape(3, -1) @ b.reshape(2, -1).T)


@pytest.mark.parametrize("density", [0.1, 0.9])
def test_gram_and_cross_moment_over_several_tiles(spark, rng, density):
    a, b = sparse_tensor(rng, (23, 9, 4), density), sparse_tensor(rng, (11, 9, 4), density)
    ta, tb = from_dense(spark, a), from_dense(spark, b)
    ua, ub = op.unfold(ta, "_1"), op.unfold(tb, "_1")
    m, n = a.reshape(23, -1), b.reshape(11, -1)
    np.testing.assert_allclose(to_dense(op.gram(ua, tile=5), (23, 23), ["_1", "_2"]), m @ m.T)
    np.testing.assert_allclose(to_dense(op.cross_moment(ua, ub, tile=5), (23, 11), ["_1", "_2"]), m @ n.T)


def test_gram_beyond_one_tile_and_repeated_cells(spark):
    t = spark.createDataFrame([(0, 5000, 1.0), (0, 5000, 2.0), (0, 1, 4.0), (1, 1, 1.0), (1, 70000, None)],
                              "k int, i int, product double")
    got = {(r[0], r[1]): r[2] for r in op.gram(t).collect()}
    assert got == {(5000, 5000): 9.0, (1, 5000): 12.0, (5000, 1): 12.0, (1, 1): 17.0}


def test_gram_shuffles_one_packed_row_per_index(spark, rng):
    plan = op.gram(op.unfold(from_dense(spark, sparse_tensor(rng, (6, 5, 4))), "_1"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2, plan


def test_partitioning_does_not_change_results(spark, rng):
    a = sparse_tensor(rng, (5, 6, 7))
    f = rng.integers(-2, 3, size=(3, 6)).astype(float)
    t = from_dense(spark, a)
    r1 = to_dense(op.ttm(t.repartition(1), matrix_df(spark, f), "_2"), (5, 3, 7))
    r2 = to_dense(op.ttm(t.repartition(7, "_3"), matrix_df(spark, f), "_2"), (5, 3, 7))
    np.testing.assert_allclose(r1, r2)
    g1 = to_dense(op.gram(op.unfold(t.repartition(1), "_2")), (6, 6), ["_1", "_2"])
    g2 = to_dense(op.gram(op.unfold(t.repartition(5), "_2")), (6, 6), ["_1", "_2"])
    np.testing.assert_allclose(g1, g2)


def test_matrix_add_and_marginal(spark):
    a = matrix_df(spark, [[1, 2], [0, 3]])
    b = matrix_df(spark, [[1, 0], [4, 0]])
    np.testing.assert_allclose(to_dense(op.matrix_add(a, b), (2, 2), ["_1", "_2"]), [[2, 2], [4, 3]])
    t = from_dense(spark, np.arange(24, dtype=float).reshape(2, 3, 4))
    got = {r["_2"]: r["product"] for r in op.mode_marginal(t, "_2").collect()}
    want = np.arange(24, dtype=float).reshape(2, 3, 4).sum(axis=(0, 2))
    assert [got[i] for i in range(3)] == list(want)


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "_1 int, _2 int, _3 int, product double")
    f = spark.createDataFrame([], "_1 int, _2 int, product double")
    assert op.ttm(e, f, "_1").count() == 0
    assert op.gram(op.unfold(e, "_1")).count() == 0
    assert op.ttm_chain(e, [f, f, f]).count() == 0


def test_fused_chain_equals_sequential(spark, rng):
    from cootensor.operators.algebra import ttm_fused
    a = sparse_tensor(rng, (4, 5, 6))
    t = from_dense(spark, a)
    # low fan-out factors (one output per input) fuse; a rank-3 factor does not
    f1 = np.zeros((2, 4)); f1[[0, 0, 1, 1], [0, 1, 2, 3]] = [1, 2, 3, 4]
    f3 = np.zeros((3, 6)); f3[[0, 1, 2, 0, 1, 2], range(6)] = 1
    g = rng.integers(-2, 3, size=(3, 5)).astype(float)
    fs = [matrix_df(spark, f1), matrix_df(spark, g), matrix_df(spark, f3)]
    want = np.einsum("ijk,ai,bj,ck->abc", a, f1, g, f3)
    np.testing.assert_allclose(to_dense(op.ttm_chain(t, fs), (2, 3, 3)), want)
    np.testing.assert_allclose(to_dense(op.ttm_chain(t, fs, fuse=False), (2, 3, 3)), want)
    fused = ttm_fused(t, [("_1", fs[0]), ("_3", fs[2])])
    np.testing.assert_allclose(to_dense(fused, (2, 5, 3)), np.einsum("ijk,ai,ck->ajc", a, f1, f3))


def test_spmm_broadcasts_the_small_side(spark, rng, monkeypatch):
    from cootensor.operators import joins
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 5)
    a = sparse_tensor(rng, (4, 2), 1.0)
    b = sparse_tensor(rng, (4, 40), 1.0)
    small = matrix_df(spark, a[:, :1][:3])         # at most 3 rows: under the patched limit of 5
    big = matrix_df(spark, b)                      # up to 160 rows: over it
    out = op.spmm_atb(small, big)
    np.testing.assert_allclose(to_dense(out, (1, 40), ["_1", "_2"]), a[:3, :1].T @ b[:3])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan
