"""Radix selection and the grid-free Frobenius error against numpy."""

import datetime

import numpy as np
from conftest import from_dense, matrix_df, to_dense
from pyspark.sql import functions as F

from cootensor import operators as op
from cootensor.operators import truncate


def test_magnitude_bits_are_the_ieee_bits(spark):
    v = [0.0, 5e-324, 2.2e-308, 2.2250738585072014e-308, 1e-300, 0.1, 0.5, 0.9999999999999999, 1.0, 1.0000000000000002, 2.0, 3.0, 4.0,
         1e22, 1.7976931348623157e308, float("inf")]
    rows = spark.createDataFrame([(x,) for x in v] + [(-x,) for x in v], "product double")
    for r in rows.select("product", truncate.magnitude_bits().alias("b")).collect():
        assert r.b == int(np.float64(abs(r.product)).view(np.int64)), r


def _brute(rows, k):
    return sorted(sorted(rows, key=lambda r: (-abs(r[-1]), r[:-1]))[:k])


def test_selection_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(truncate, "_DIRECT_K", 0)
    rng = np.random.default_rng(3)
    rows = sorted({(int(a), int(b), "xyz"[c]) for a, b, c in rng.integers(0, [70_000, 9, 3], (400, 3))})
    cells = [r + (float(v),) for r, v in zip(rows, rng.integers(-4, 4, len(rows)))]
    t = spark.createDataFrame(cells, "a int, b int, c string, product double")
    for k in (1, 60, 200, len(cells) - 1, len(cells), 10_000):
        assert sorted(tuple(r) for r in op.top_k(t, k).collect()) == _brute(cells, k)
    ones = [r + (1.0,) for r in rows]
    t = spark.createDataFrame([(*r[2::-1], 1.0) for r in ones], "c string, b int, a int, product double")
    assert sorted(tuple(r) for r in op.top_k(t, 123).collect()) == _brute([(*r[2::-1], 1.0) for r in ones], 123)


def test_selection_with_repeated_cells_and_negative_indices(spark, monkeypatch):
    monkeypatch.setattr(truncate, "_DIRECT_K", 0)
    t = spark.createDataFrame([(-1, 2.0), (0, 2.0), (0, -2.0), (0, 2.0), (3, 2.0), (4, 1.0), (5, None)], "a int, product double")
    got = [tuple(r) for r in op.top_k(t, 3).collect()]
    assert len(got) == 3 and sorted(a for a, _ in got) == [-1, 0, 0]
    assert op.top_k(t, 6).count() == 6


def test_selection_of_odd_magnitudes_and_coordinates(spark, monkeypatch):
    monkeypatch.setattr(truncate, "_DIRECT_K", 0)
    size = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 4e-18, 4.3e-18, 0.1, 1.0, 1.0000000000000002, 2.3e17, 2.4e17, 1e300,
            1.7976931348623157e308, float("inf"), float("nan")]
    rng = np.random.default_rng(11)
    labels = [None, datetime.date(1969, 12, 31), datetime.date(1970, 1, 1), datetime.date(2024, 2, 29)]
    whole = [None, -(2 ** 63), -1, 0, 1, 2 ** 53, 2 ** 53 + 1, 2 ** 63 - 2, 2 ** 63 - 1]
    rows = [(labels[a], whole[b], size[c] * (1 if b % 2 else -1)) for a, b, c in sorted({tuple(map(int, r)) for r in rng.integers(0, [4, 9, 15], (400, 3))})]

    def order(r):
        v = abs(r[2])
        return (v == v, -v if v == v else 0, r[0] is None, r[0] or datetime.date(1, 1, 1), r[1] is None, r[1] or 0)

    t = spark.createDataFrame(rows, "a date, b long, product double")
    for columns in (["a", "b"], ["b", "a"]):
        for k in (1, 150, len(rows) - 1):
            by = order if columns == ["a", "b"] else lambda r: order(r)[:2] + order(r)[4:] + order(r)[2:4]
            want = sorted(map(repr, sorted(rows, key=by)[:k]))
            assert sorted(repr((r.a, r.b, r.product)) for r in op.top_k(t.select(*columns, "product"), k).collect()) == want, (columns, k)


def _written(monkeypatch):
    """The rows of every frame that is written to the checkpoint folder."""
    from pyspark.sql.classic.dataframe import DataFrame
    rows, real = [], DataFrame.checkpoint

    def checkpoint(self, *args, **kw):
        out = real(self, *args, **kw)
        rows.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "checkpoint", checkpoint)
    return rows


def test_large_selection_writes_only_cells_near_the_last(spark, monkeypatch):
    rows = _written(monkeypatch)
    t = spark.range(200_000).select(F.col("id").cast("int").alias("i"), ((F.col("id") * 7919) % 200_003).cast("double").alias("product"))
    got = op.top_k(t, 2_000)
    assert sorted(r.i for r in got.collect()) == sorted(sorted(range(200_000), key=lambda i: -(i * 7919 % 200_003))[:2_000])
    assert rows and max(rows) <= 4 * 2_000


def test_large_selection_among_ties_writes_only_cells_near_the_last(spark, monkeypatch):
    rows = _written(monkeypatch)
    t = spark.range(200_000).select(((F.col("id") * 7919) % 200_003).alias("i"), (F.col("id") % 3).cast("int").alias("j"), F.lit(1.0).alias("product"))
    got = op.top_k(t, 2_000)
    assert sorted(r.i for r in got.collect()) == sorted(i * 7919 % 200_003 for i in range(200_000))[:2_000]
    assert rows and max(rows) <= 4 * 2_000


def test_frobenius_error_equals_the_grid(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, size=(4, 3, 5)).astype(float)
    fs = [rng.normal(size=(2, n)) for n in x.shape]
    g = rng.normal(size=(2, 2, 2))
    g[1, 0, 1] = 0
    r = op.frobenius_mse(from_dense(spark, x, ["a", "b", "c"]), from_dense(spark, g, ["a", "b", "c"]), [matrix_df(spark, f) for f in fs]).first()
    want = np.einsum("ijk,ia,jb,kc->abc", g, *fs)
    assert r.n == 60
    np.testing.assert_allclose([r.sse, r.mse], [((x - want) ** 2).sum(), ((x - want) ** 2).mean()], rtol=1e-9)
