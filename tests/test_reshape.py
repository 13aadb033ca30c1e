import numpy as np
from pyspark.sql import functions as F

from cootensor import operators as op
from cootensor.tensor import nnz_density, shape_of, tensor_shape
from conftest import from_dense, to_dense


def test_unfold_fold_roundtrip_any_arity(spark):
    rng = np.random.default_rng(1)
    for shape in [(3,), (2, 3), (2, 3, 4), (2, 2, 2, 2, 3)]:
        a = rng.integers(0, 3, size=shape).astype(float)
        t = from_dense(spark, a)
        for m in t.columns[:-1]:
            u = op.unfold(t, m)
            assert u.columns[1:] == [m, "product"]
            back = op.fold(u, t.columns)
            assert back.columns == t.columns
            np.testing.assert_allclose(to_dense(back, shape), a)


def test_unfold_key_keeps_names_and_types(spark):
    t = spark.createDataFrame([("a", 1, 2, 1.0)], "s string, i int, j int, product double")
    u = op.unfold(t, "i")
    assert u.columns == ["s+j", "i", "product"]
    assert u.schema["s+j"].dataType.simpleString() == "struct<s:string,j:int>"


def test_transpose_twice_is_identity(spark):
    m = spark.createDataFrame([(0, 1, 2.0), (3, 4, 5.0)], "_1 int, _2 int, product double")
    assert sorted(op.transpose(op.transpose(m)).collect()) == sorted(m.collect())
    assert sorted(op.transpose(m).collect()) == sorted([(1, 0, 2.0), (4, 3, 5.0)])


def test_vstack_tags_inputs(spark):
    m = spark.createDataFrame([(0, 1, 2.0)], "_1 int, _2 int, product double")
    v = op.vstack(m, m, m)
    assert v.columns == ["MATRIX_ID", "_1", "_2", "product"]
    assert sorted(r[0] for r in v.collect()) == [0, 1, 2]


def test_collapse_aggregates_duplicates(spark):
    t = spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0), (2, 0, 1.0)], "a int, b int, product double")
    agg = {(r.a, r.b): r.product for r in op.collapse_modes(t, ["a"]).collect()}
    assert agg == {(0, 1): 5.0, (0, 0): 1.0}
    raw = op.collapse_modes(t, ["a"], aggregate=False)
    assert raw.count() == 3                          # D8 behaviour on request


def test_rebase_and_time_slice(spark):
    t = spark.createDataFrame([(0, 10, 1.0), (0, 12, 2.0), (1, 15, 3.0)], "a int, h int, product double")
    r = op.rebase(op.time_slice(t, "h", lo=10), "h")
    assert sorted((x.a, x.h) for x in r.collect()) == [(0, 0), (1, 3)]
    assert r.schema["h"].dataType.simpleString() == "int"


def test_rename_bias_split_and_encode(spark):
    t = spark.createDataFrame([(1, 2, 3.0)], "x int, y int, v double")
    assert op.rename_modes(t).columns == ["_1", "_2", "product"]
    b = spark.createDataFrame([(0, 0, 9.0), (0, 1, 1.0), (0, 3, 2.0)], "_1 int, _2 int, product double")
    bias, w = op.bias_split(b, "m")
    assert bias.collect()[0].asDict() == {"m": 0, "bias": 9.0}
    assert sorted((r._1, r._2, r.product) for r in w.collect()) == [(0, 0, 1.0), (0, 2, 2.0)]
    assert sorted(r._2 for r in op.bias_encode(w, 1).collect()) == [1, 3]


def test_cell_lookup(spark):
    t = from_dense(spark, np.arange(1, 9, dtype=float).reshape(2, 2, 2))
    r = op.cell_lookup(t, {"_1": 1, "_2": 0, "_3": 1}).collect()
    assert [x.product for x in r] == [6.0]


def test_shape_nnz_density(spark):
    t = from_dense(spark, np.array([[0, 1.0], [2.0, 0]]))
    assert shape_of(t) == [2, 2]
    row = nnz_density(t).first()
    assert (row.nnz, row.dense_cells, row.density) == (2, 4.0, 0.5)
    e = spark.createDataFrame([], "_1 int, product double")
    assert tensor_shape(e).first()[0] is None and shape_of(e) == [0]
