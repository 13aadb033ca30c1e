"""Block conjugate gradients on stored and implicit matrices against numpy."""

import numpy as np
import pytest
from conftest import from_dense, matrix_df, to_dense
from pyspark.sql import functions as F

from cootensor.plans import regression as reg
from cootensor.plans.blockcg import MatrixOperator, NormalOperator, block_cg
from cootensor.sources.runstore import RunStore


def test_stored_matrix_with_equal_and_zero_targets(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(12, 30))
    a, c = m @ m.T + 0.1 * np.eye(12), rng.normal(size=(8, 12))
    c[3], c[5] = c[1], 0                                     # dependent directions are dropped
    steps = []
    store = RunStore(spark)
    b = block_cg(MatrixOperator(matrix_df(spark, a), store), matrix_df(spark, c), store, steps=steps)
    np.testing.assert_allclose(to_dense(b, c.shape, ["_1", "_2"]), np.linalg.solve(a, c.T).T, rtol=1e-8, atol=1e-10)
    assert steps[0] <= 8                                     # fewer than the 12 steps of one target at a time
    assert b.where("_1 = 5").count() == 0


def test_blocks_hold_only_what_the_matrix_connects(spark):
    a = [(i, i, 2.0) for i in range(40)] + [(i, i ^ 1, 1.0) for i in range(40)]
    c = [(t, 5 * t, 1.0) for t in range(0, 8)]
    store = RunStore(spark)
    frame = lambda rows: spark.createDataFrame(rows, "_1 int, _2 int, product double")
    b = block_cg(MatrixOperator(frame(a), store), frame(c), store)
    assert b.count() == 16                                   # each target reaches the two indices of its pair
    assert {(r._1, r._2): round(r.product, 9) for r in b.collect()}[(1, 5)] == round(2 / 3, 9)


def test_index_without_equation_is_refused(spark):
    store = RunStore(spark)
    with pytest.raises(ValueError):
        block_cg(MatrixOperator(matrix_df(spark, np.eye(2)), store), matrix_df(spark, np.ones((1, 3))), store)


def test_implicit_normal_matrix_equals_the_stored_one(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(5, 4, 6)).astype(float)     # cells and whole fibers may be absent
    x[:, 2, 3] = 0
    y = rng.normal(size=(3, 4, 6))
    tx, ty = from_dense(spark, x, ["a", "b", "h"]), from_dense(spark, y, ["a", "b", "h"])
    free, _ = reg.regression_step(tx, ty, [None], 0, precision=None, route="matrix_free", checkpoint=False)
    local, _ = reg.regression_step(tx, ty, [None], 0, precision=None, route="local", checkpoint=False)
    np.testing.assert_allclose(to_dense(free, (3, 6), ["_1", "_2"]), to_dense(local, (3, 6), ["_1", "_2"]), rtol=1e-7, atol=1e-9)


def test_repeated_cells_and_nulls(spark):
    rows = [(0, 0, 1.0), (0, 0, 2.0), (0, 1, 1.0), (1, 1, 4.0), (1, None, 3.0), (1, 0, None)]
    u = spark.createDataFrame(rows, "k int, i int, v double")
    store = RunStore(spark)
    c = np.array([[1.0, 2.0, 3.0]])
    b = block_cg(NormalOperator(u, 5.0, 0.5, store), matrix_df(spark, c), store)
    m = np.array([[3.0, 0.0], [1.0, 4.0]])                    # index x fiber
    a = np.block([[np.array([[5.0]]), m.sum(1)[None]], [m.sum(1)[:, None], m @ m.T]]) + 0.5 * np.eye(3)
    np.testing.assert_allclose(to_dense(b, (1, 3), ["_1", "_2"]), np.linalg.solve(a, c.T).T, rtol=1e-8)


def test_mode_of_200000_indices(spark):
    """The normal matrix would hold 7 * 10^9 cells; the step holds a few rows per index."""
    d, fibers = 200_000, 6
    rows = spark.range(d).select((F.col("id") % fibers).cast("int").alias("h"), F.col("id").cast("int").alias("a"),
                                 (1 + F.col("id") % 5).cast("double").alias("product"))
    y = np.random.default_rng(4).normal(size=(2, fibers))
    ty = from_dense(spark, y, ["a", "h"])
    b, _ = reg.regression_step(rows.select("a", "h", "product"), ty, [None], 0, precision=None, checkpoint=False)
    x = np.arange(d)
    v, h = 1.0 + x % 5, x % fibers
    # fibers are disjoint, so Z'Z is 1 plus a diagonal; B = Y (Z'Z + ridge)^-1 Z'
    k = np.ones((fibers, fibers)) + np.diag(np.bincount(h, v * v)) + 0.001 * np.eye(fibers)
    w = np.linalg.solve(k, y.T).T
    got = b.groupBy("_1").agg(F.count("*").alias("n"), F.sum("product").alias("s")).orderBy("_1").collect()
    assert [r.n for r in got] == [d + 1, d + 1]
    for t in (0, 1):
        assert abs(got[t].s - (w[t].sum() + (w[t][h] * v).sum())) < 1e-8
    some = {(r._1, r._2): r.product for r in b.where("_2 IN (0, 1, 77)").collect()}
    for t in (0, 1):
        assert abs(some[t, 0] - w[t].sum()) < 1e-9
        assert abs(some[t, 78 - 1] - w[t][h[76]] * v[76]) < 1e-9
