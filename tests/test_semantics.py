"""One test per reference rule that is easy to get wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cootensor import operators as op
from cootensor.operators import truncate
from conftest import from_dense, to_dense


def test_sparsify_is_strict_and_uses_magnitude(spark):
    t = spark.createDataFrame([(0, 0.5), (1, -0.7), (2, 0.2), (3, -0.5)], "_1 int, product double")
    assert sorted(r._1 for r in op.sparsify(t, 0.5).collect()) == [1]


def test_top_k_ties_broken_by_coordinates(spark):
    t = spark.createDataFrame([(2, 1, 5.0), (1, 1, -5.0), (0, 3, 5.0), (0, 0, 1.0)],
                              "a int, b int, product double")
    got = [(r.a, r.b) for r in op.top_k(t, 2).collect()]
    assert sorted(got) == [(0, 3), (1, 1)]
    assert op.top_k(t, 10).count() == 4


def test_top_k_prefilter_path_is_exact(spark, monkeypatch):
    monkeypatch.setattr(truncate, "_DIRECT_K", 2)
    rng = np.random.default_rng(3)
    vals = rng.integers(-50, 50, size=400).astype(float)
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, product double")
    got = sorted(r.i for r in op.top_k(t, 37).collect())
    order = sorted(range(400), key=lambda i: (-abs(vals[i]), i))[:37]
    assert got == sorted(order)


def test_affine_bias_only_on_present_cells_and_inner(spark):
    # T: mode a in {0, 1}; factor maps input 0 -> outputs 0 and 1, bias only for output 0
    t = spark.createDataFrame([(0, 0, 2.0), (1, 1, 3.0)], "a int, h int, product double")
    b = spark.createDataFrame([(0, 0, 10.0), (0, 1, 1.0), (1, 1, 4.0)], "_1 int, _2 int, product double")
    out = {(r.a, r.h): r.product for r in op.affine_ttm(t, b, "a", precision=None).collect()}
    # output 1 has no bias row -> its cells vanish; time h=1 has no product -> no bias added
    assert out == {(0, 0): 12.0}


def test_threshold_before_vs_after_bias(spark):
    t = spark.createDataFrame([(0, 0, 0.3)], "a int, h int, product double")
    b = spark.createDataFrame([(0, 0, 5.0), (0, 1, 1.0)], "_1 int, _2 int, product double")
    before = op.affine_ttm(t, b, "a", precision=0.5, threshold="before")
    after = op.affine_ttm(t, b, "a", precision=0.5, threshold="after")
    assert before.count() == 0                  # 0.3 cut before the bias is added
    assert [r.product for r in after.collect()] == [5.3]


def test_predict_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(1, 5, size=(3, 2, 4)).astype(float)       # modes a, b, free h
    wa = rng.integers(1, 3, size=(2, 3)).astype(float)
    ba = np.array([1.0, 2.0])
    wb = rng.integers(1, 3, size=(2, 2)).astype(float)
    bb = np.array([0.5, 0.0])
    t = from_dense(spark, x, ["a", "b", "h"])

    def factor(w, bias):
        rows = [(i, 0, float(bias[i])) for i in range(len(bias))]
        rows += [(i, j + 1, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])]
        return spark.createDataFrame(rows, "_1 int, _2 int, product double")

    got = to_dense(op.predict(t, [factor(wa, ba), factor(wb, bb)], precision=None), (2, 2, 4))
    step = np.einsum("abh,ra->rbh", x, wa) + ba[:, None, None]
    want = np.einsum("abh,rb->arh", step, wb) + bb[None, :, None]
    np.testing.assert_allclose(got, want)


def test_lag_expand_and_xy_split(spark):
    t = spark.createDataFrame([(0, h, float(h + 1)) for h in range(6)], "e int, h int, product double")
    tl = op.lag_expand(t, "h", 4)
    assert tl.columns == ["e", "lag", "h", "product"]
    assert tl.count() == 24
    done = sorted(r.h for r in op.complete_times(tl, "h", "lag", 4).collect())
    assert done == [3, 4, 5]
    x, y = op.xy_split(tl, "h", "lag", 4)
    assert sorted(r.lag for r in x.collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    # target = the oldest observation x(T-3), lag collapsed to 0
    assert sorted((r.h, r.lag, r.product) for r in y.collect()) == [(3, 0, 1.0), (4, 0, 2.0), (5, 0, 3.0)]
    xf, yf = op.xy_split(tl, "h", "lag", 4, target_lag=0)
    assert sorted((r.h, r.product) for r in yf.collect()) == [(3, 4.0), (4, 5.0), (5, 6.0)]


def test_cut_and_rebase_uses_x_minimum(spark):
    x = spark.createDataFrame([(0, 5, 1.0), (0, 7, 1.0)], "e int, h int, product double")
    y = spark.createDataFrame([(0, 6, 1.0), (0, 3, 1.0)], "e int, h int, product double")
    xr, yr = op.cut_and_rebase(x, y, "h", after=4)
    assert sorted(r.h for r in xr.collect()) == [0, 2]
    assert sorted(r.h for r in yr.collect()) == [1]


def test_r2_matches_numpy_and_null_when_constant(spark):
    y = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 5, 7, 9])], "i int, product double")
    p = spark.createDataFrame([(i, float(v)) for i, v in enumerate([2.5, 5.5, 0.0, 9.0])], "i int, product double")
    s = op.r2(y, p).first()                      # pred 0.0 dropped (> 0 only)
    yy, pp = np.array([3, 5, 9.0]), np.array([2.5, 5.5, 9.0])
    want = 1 - ((yy - pp) ** 2).sum() / ((yy - yy.mean()) ** 2).sum()
    assert s.n == 3 and abs(s.r2 - want) < 1e-12
    s1 = op.r2(y, p, min_pred=3.0).first()
    assert s1.n == 2
    c = spark.createDataFrame([(0, 4.0), (1, 4.0)], "i int, product double")
    assert op.r2(c, c).first().r2 is None


def test_mse_inner_and_outer(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, product double")
    b = spark.createDataFrame([(1, 4.0), (2, 3.0)], "i int, product double")
    inner = op.mse(a, b).first()
    assert (inner.n, inner.mse) == (1, 4.0)
    outer = op.mse(a, b, how="outer").first()
    assert outer.n == 3 and abs(outer.mse - (1 + 4 + 9) / 3) < 1e-12
