"""Adaptive range finder (J2), fiber-side eigenvectors and HOOI (J3) against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cootensor.operators.reshape import unfold
from cootensor.plans.rangefinder import range_vectors
from cootensor.plans.regression import svd_init_factors
from cootensor.plans.solve import fiber_eigvecs, jacobi_eigh
from tests.conftest import from_dense, to_dense


def _low_rank(spark, d=100_000, fibers=300, seed=3):
    """d x fibers of rank 6: index j is in block j % 6 and block b lives on fibers with f % 6 == b."""
    j = spark.range(d, numPartitions=8).select(F.col("id").cast("int").alias("a"))
    scale = F.element_at(F.array(*[F.lit(float(2 ** -b)) for b in range(6)]), F.col("a") % 6 + 1)
    return j.select("a", F.explode(F.sequence(F.lit(0), F.lit(fibers // 6 - 1))).alias("f"), scale.alias("s")) \
        .select("a", (F.col("f") * 6 + F.col("a") % 6).alias("h"),
                (F.col("s") * (1 + F.col("a") % 7) * (1 + F.col("f") % 5)).alias("product"))


def test_range_of_a_mode_of_100000_indices(spark):
    x = _low_rank(spark)
    f, s = range_vectors(unfold(x, "a"), 1e-6, start=4)
    assert len(s) == 6
    weight = {b: 0.0 for b in range(6)}
    j = np.arange(100_000)
    for b in range(6):
        weight[b] = 2.0 ** -b * np.sqrt(((1 + j[j % 6 == b] % 7.0) ** 2).sum() * ((1 + np.arange(50) % 5.0) ** 2).sum())
    np.testing.assert_allclose(s, sorted(weight.values(), reverse=True), rtol=1e-9)
    norms = {r["_1"]: r["n"] for r in f.groupBy("_1").agg(F.sum(F.col("product") ** 2).alias("n")).collect()}
    assert norms.keys() == set(range(6)) and all(abs(n - 1) < 1e-9 for n in norms.values())
    top = f.where("_1 = 0 and abs(product) > 1e-9").select("_2", "product").toPandas()
    assert (top["_2"] % 6 == 0).all()
    want = (1 + top["_2"] % 7) * 2.0 ** 0 * np.sqrt(((1 + np.arange(50) % 5.0) ** 2).sum()) / s[0]
    np.testing.assert_allclose(top["product"].abs(), want, rtol=1e-7)


def test_tolerance_decides_the_rank(spark):
    rng = np.random.default_rng(1)
    q1, q2 = np.linalg.qr(rng.normal(size=(30, 30)))[0], np.linalg.qr(rng.normal(size=(40, 30)))[0]
    sig = 10.0 ** -np.arange(30)
    u = from_dense(spark, (q1 * sig) @ q2.T, ["a", "h"])
    for tol, rank in ((0.05, 2), (0.5e-3, 4)):
        f, s = range_vectors(unfold(u, "a"), tol, start=4, power=2)
        assert len(s) == rank
        got = to_dense(f, (rank, 30))
        assert np.abs(np.abs((got * q1.T[:rank]).sum(1)) - 1).max() < 1e-6
    with pytest.raises(ValueError, match="max_rank"):
        range_vectors(unfold(u, "a"), 1e-5, start=2, max_rank=3)
    with pytest.raises(ValueError, match="rounding"):
        range_vectors(unfold(u, "a"), 1e-9)


def test_empty_zero_null_and_repeated_cells(spark):
    schema = "a int, h int, product double"
    for rows in ([], [(0, 0, 0.0)], [(0, 1, None), (None, 1, 2.0)]):
        f, s = range_vectors(unfold(spark.createDataFrame(rows, schema), "a"))
        assert f.count() == 0 and len(s) == 0
    f, s = range_vectors(unfold(spark.createDataFrame([(0, 0, 1.5), (0, 0, 1.5), (1, 0, 4.0), (1, 1, None)], schema), "a"))
    assert len(s) == 1 and abs(s[0] - 5) < 1e-12
    np.testing.assert_allclose(np.abs(to_dense(f, (1, 2))), [[0.6, 0.8]], atol=1e-12)


def test_svd_start_leaves_out_arbitrary_components(spark):
    a = np.outer([1.0, 2, 2], [3.0, 4]) / 1.0
    x = from_dense(spark, a, ["a", "h"])
    f, = svd_init_factors(x, x)
    have = {(r._1, r._2): r.product for r in f.collect()}
    assert set(have) == {(i, c) for i in range(3) for c in (0, 1)}
    assert abs(have[(0, 1)] - 1 / 3) < 1e-9 and abs(have[(2, 1)] - 2 / 3) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33])
def test_jacobi_matches_eigh_and_keeps_small_vectors(n):
    rng = np.random.default_rng(n)
    y = rng.normal(size=(60, n))
    w, v = jacobi_eigh(y.T @ y)
    np.testing.assert_allclose(w, np.linalg.eigvalsh(y.T @ y)[::-1], rtol=1e-10)
    np.testing.assert_allclose(v.T @ v, np.eye(n), atol=1e-12)
    scaled = y * 10.0 ** -np.arange(n).clip(max=7)
    w, v = jacobi_eigh(scaled.T @ scaled)
    np.testing.assert_allclose(np.sqrt(w), np.linalg.svd(scaled)[1], rtol=1e-9)


def test_fiber_eigvecs_match_svd(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(50, 2, 3)) * np.array([1.0, 1e-4, 10])
    u, s, _ = np.linalg.svd(y.reshape(50, -1), full_matrices=False)
    got = to_dense(fiber_eigvecs(unfold(from_dense(spark, y, ["a", "b", "c"]), "a"), 4, [2, 3]), (4, 50))
    want = u[:, :4].T * np.sign(u[np.abs(u).argmax(0)[:4], np.arange(4)])[:, None]
    np.testing.assert_allclose(got, want, atol=1e-9)
    one = from_dense(spark, np.ones((4, 2, 2)), ["a", "b", "c"])
    assert fiber_eigvecs(unfold(one, "a"), 2, [2, 2]) is None
