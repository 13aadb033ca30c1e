"""Hand-made edge inputs (FIXTURES.md §4)."""

import numpy as np
from pyspark.sql import functions as F

from cootensor import operators as op
from cootensor.plans import regression as reg
from cootensor.plans.solve import leading_eigvecs
from cootensor.tensor import nnz_density, shape_of
from conftest import from_dense, to_dense


def test_empty_tensor_everywhere(spark):
    e = spark.createDataFrame([], "a int, h int, product double")
    assert shape_of(e) == [0, 0]
    assert nnz_density(e).first().nnz == 0
    assert op.top_k(e, 5).count() == 0
    assert op.lag_expand(e, "h", 3).count() == 0
    x, y = op.xy_split(op.lag_expand(e, "h", 3), "h", "lag", 3)
    assert x.count() == 0 and y.count() == 0
    s = op.r2(e, e).first()
    assert s.n == 0 and s.r2 is None                      # typed empty result, no 0/0 failure (D15)
    assert op.mse(e, e).first().n == 0


def test_one_cell(spark):
    t = spark.createDataFrame([(2, 3, 5.0)], "_1 int, _2 int, product double")
    f = spark.createDataFrame([(0, 2, 2.0)], "_1 int, _2 int, product double")
    assert [tuple(r) for r in op.ttm(t, f, "_1").collect()] == [(0, 3, 10.0)]
    g = op.gram(op.unfold(t, "_1")).collect()
    assert [tuple(r) for r in g] == [(2, 2, 25.0)]
    v = leading_eigvecs(op.unfold(t, "_1"), 1).collect()
    assert [(r._1, r._2, round(r.product, 12)) for r in v if r.product != 0] == [(0, 2, 1.0)]


def test_one_mode_tensor(spark):
    t = spark.createDataFrame([(0, 1.0), (3, 2.0)], "a int, product double")
    u = op.unfold(t, "a")
    assert u.columns[1:] == ["a", "product"]
    assert sorted(tuple(r) for r in op.fold(u, t.columns).collect()) == [(0, 1.0), (3, 2.0)]
    g = {(r._1, r._2): r.product for r in op.gram(u).collect()}   # a single fiber
    assert g == {(0, 0): 1.0, (0, 3): 2.0, (3, 0): 2.0, (3, 3): 4.0}


def test_index_gaps_keep_ridge_solvable(spark):
    # source indices 0 and 3 only: rows/columns 2, 3 of A hold nothing but the ridge
    rows = [(a, h, float(1 + a + h)) for a in (0, 3) for h in range(6)]
    x = spark.createDataFrame(rows, "a int, h int, product double")
    y = spark.createDataFrame([(0, h, float(2 * h + 1)) for h in range(6)], "a int, h int, product double")
    b, _ = reg.regression_step(x, y, [None], 0, precision=None, route="local")
    got = {(r._1, r._2): r.product for r in b.collect()}
    assert all(np.isfinite(v) for v in got.values())
    assert (0, 2) not in got and (0, 3) not in got             # empty indices get no weight


def test_duplicate_coordinates(spark):
    t = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 0, 4.0)], "a int, b int, product double")
    agg = t.groupBy("a", "b").agg(F.sum("product").alias("product"))
    g1 = to_dense(op.gram(op.unfold(t, "a")), (2, 2), ["_1", "_2"])
    g2 = to_dense(op.gram(op.unfold(agg, "a")), (2, 2), ["_1", "_2"])
    np.testing.assert_allclose(g1, g2)                          # same as the self-join would give
    f = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "_1 int, _2 int, product double")
    assert op.ttm(t, f, "a").collect()[0].product == 7.0


def test_string_modes(spark):
    t = spark.createDataFrame([("x", 0, 1.0), ("y", 1, 2.0), ("x", 1, -3.0)], "s string, i int, product double")
    f = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "_1 int, _2 int, product double")
    got = {r.s: r.product for r in op.ttm(t, f, "i").collect()}
    assert got == {"x": -2.0, "y": 2.0}
    assert sorted(r.s for r in op.sparsify(t, 1.5).collect()) == ["x", "y"]
    c = op.collapse_modes(t, ["i"]).collect()
    assert {(r.s, r.i): r.product for r in c} == {("x", 0): -2.0, ("y", 0): 2.0}


def test_one_very_long_fiber(spark):
    rng = np.random.default_rng(21)
    d = 1500
    a = np.zeros((d, 3))
    a[:, 0] = rng.integers(1, 4, size=d)          # fiber 0 holds every index
    a[:5, 1] = 1.0
    a[7, 2] = 2.0
    t = from_dense(spark, a)
    g = to_dense(op.gram(op.unfold(t, "_1")), (d, d), ["_1", "_2"])
    np.testing.assert_allclose(g, a @ a.T)
