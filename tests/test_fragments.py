"""Gram and cross moments of fibers that span many fragments."""

import numpy as np
from pyspark.sql import functions as F

from cootensor.operators import dense


def _dense(df, shape):
    g = np.zeros(shape)
    for r in df.collect():
        g[r._1, r._2] += r.product
    return g


def test_long_fibers_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(dense, "FRAGMENT", 2)
    rng = np.random.default_rng(1)
    d, fibers = 60, 5
    a = rng.integers(-3, 4, (fibers, d)) * (rng.random((fibers, d)) < [[1.0], [0.9], [0.5], [0.05], [0.02]])
    rows = [(f, i, float(a[f, i])) for f in range(fibers) for i in range(d) if a[f, i]]
    u = spark.createDataFrame(rows + [(0, 3, 2.0)], "k int, i int, v double")          # a repeated coordinate adds up
    a[0, 3] += 2
    np.testing.assert_array_equal(_dense(dense.fiber_gram(u, tile=4), (d, d)), a.T @ a)
    b = rng.integers(-3, 4, (fibers, 31)) * (rng.random((fibers, 31)) < 0.6)
    w = spark.createDataFrame([(f, i, float(b[f, i])) for f in range(fibers) for i in range(31) if b[f, i]], "k int, i int, v double")
    np.testing.assert_array_equal(_dense(dense.fiber_cross(w, u, tile=4), (31, d)), b.T @ a)


def test_no_row_holds_a_whole_fiber(spark):
    u = spark.range(0, 400_000, 1).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("i"), F.lit(1.0).alias("v"))
    rows = dense._fragments(dense._entries(u, 0), dense.TILE_DIM).select(F.size("bs").alias("n")).collect()
    assert len(rows) == 13 and max(r.n for r in rows) <= dense.FRAGMENT
