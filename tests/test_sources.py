import numpy as np
from pyspark.sql import functions as F

from cootensor.sources import (build_tensor, dense_index, index_grid, index_grid_df, index_modes,
                               read_csv_tensor)
from cootensor.sources.runstore import RunStore


def test_csv_bad_rows_become_null(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("0,1,2,1.5\n3,x,4,2.5\n5,6,7,oops\n")
    t = read_csv_tensor(spark, str(p), 3)
    assert t.columns == ["_1", "_2", "_3", "product"]
    rows = sorted(t.collect(), key=lambda r: r._1)
    assert rows[0].asDict() == {"_1": 0, "_2": 1, "_3": 2, "product": 1.5}
    assert rows[1]._2 is None and rows[2].product is None


def test_index_grid_variants(spark):
    g = index_grid(spark, [2, 3], ["a", "b"])
    assert sorted((r.a, r.b) for r in g.collect()) == [(i, j) for i in range(2) for j in range(3)]
    sizes = spark.createDataFrame([(3, 2, 2)], "x int, y int, z int")
    g2 = index_grid_df(sizes, ["x", "y", "z"])
    assert g2.count() == 12 and g2.distinct().count() == 12
    empty = spark.createDataFrame([(0, 2)], "x int, y int")
    assert index_grid_df(empty, ["x", "y"]).count() == 0


def test_dense_index_matches_rank_over_many_partitions(spark):
    rng = np.random.default_rng(0)
    vals = [f"k{v:05d}" for v in rng.integers(0, 3000, size=5000)]
    df = spark.createDataFrame([(v,) for v in vals], "k string").repartition(13)
    d = {r.k: r.idx for r in dense_index(df, "k", "idx").collect()}
    want = {v: i for i, v in enumerate(sorted(set(vals)))}
    assert d == want


def test_index_modes_and_build(spark):
    df = spark.createDataFrame([("b", "x", 1.0), ("a", "x", 2.0), ("b", "y", -1.0), ("b", "y", 1.0)],
                               "s string, t string, v double")
    cells = build_tensor(df, ["s", "t"], "v")
    assert cells.count() == 2                        # (b, y) sums to 0 and is dropped
    out, dicts = index_modes(cells, ["s", "t"])
    assert sorted((r.s, r.t, r.product) for r in out.collect()) == [(0, 0, 2.0), (1, 0, 1.0)]
    assert sorted((r.s, r.s__idx) for r in dicts["s"].collect()) == [("a", 0), ("b", 1)]


def test_runstore_factor_table_and_snapshot(spark):
    rs = RunStore(spark)
    f = spark.createDataFrame([(0, 1, 2.0)], "_1 int, _2 int, product double")
    back = rs.save_factor(f, 3, 1)
    assert back.collect()[0].asDict() == {"_1": 0, "_2": 1, "product": 2.0}
    tab = rs.factor_table()
    assert tab.filter("iter = 3 and mode = 1").count() == 1
    rs.snapshot([f, f], 3)
    assert rs.load_factor(3, 1, "saved").count() == 1
    other = RunStore(spark)
    assert other.root != rs.root                     # per-run folders (D2)


def test_decode_modes_roundtrip(spark):
    from cootensor.sources import decode_modes
    df = spark.createDataFrame([("b", "x", 1.0), ("a", "y", 2.0), ("c", "x", 4.0)], "s string, t string, product double")
    idx, dicts = index_modes(df, ["s", "t"])
    back = decode_modes(idx, dicts)
    assert back.columns == df.columns
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_dense_index_ranks_many_partitions(spark):
    from cootensor.sources import build
    rng = np.random.default_rng(5)
    vals = [f"v{v:05d}" for v in rng.integers(0, 4000, size=6000)]
    df = spark.createDataFrame([(v,) for v in vals], "k string").repartition(9)
    got = {r.k: r.idx for r in build.dense_index(df, "k", "idx").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(vals)))}


def test_null_labels_keep_their_rows(spark):
    from cootensor.sources.build import decode_modes, index_modes
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", 3.0)], "k string, product double")
    out, dicts = index_modes(df, ["k"])
    assert {(r.k, r.product) for r in out.collect()} == {(0, 1.0), (1, 3.0), (2, 2.0)}
    assert {(r.k, r.product) for r in decode_modes(out, dicts).collect()} == {("a", 1.0), (None, 2.0), ("b", 3.0)}
    lost = spark.createDataFrame([(7, 1.0)], "k int, product double")
    assert [tuple(r) for r in decode_modes(lost, dicts).collect()] == [(None, 1.0)]


def test_size_checks_leave_nothing_cached(spark):
    from cootensor import operators as op
    from cootensor.operators.joins import fits_broadcast
    t = spark.range(100).selectExpr("cast(id % 10 as int) a", "cast(id div 10 as int) b", "1.0D product")
    f = spark.range(10).selectExpr("cast(id % 2 as int) _1", "cast(id as int) _2", "1.0D product")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    op.ttm_chain(t, [f, f]).count()
    op.spmm_atb(t, t).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    wide = spark.range(1000).selectExpr("id", "repeat('x', 1000) s")
    assert fits_broadcast(wide) and not fits_broadcast(wide, max_bytes=100_000) and not fits_broadcast(wide, max_rows=10)


def test_runstore_drop(spark):
    rs = RunStore(spark)
    rs.save_factor(spark.createDataFrame([(0, 0, 1.0)], "_1 int, _2 int, product double"), 0, 0)
    assert rs.factor_table().count() == 1
    assert rs.drop()
    import pytest
    with pytest.raises(Exception):
        rs.factor_table().count()


def test_extended_dictionary_keeps_old_ids(spark):
    from cootensor.sources.build import dense_index, extend_index
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "w string")
    d0 = dense_index(rows("m", "c", "c"), "w", "id")
    d1 = extend_index(d0, rows("z", "a", "m", None), "w", "id")
    d2 = extend_index(d1, rows(None, "b", "a"), "w", "id")
    assert sorted((r.id, r.w, r.version) for r in d2.collect()) == [(0, "c", 0), (1, "m", 0), (2, "a", 1), (3, "z", 1), (4, None, 1), (5, "b", 2)]
    assert extend_index(d2, rows("a"), "w", "id").count() == 6
    empty = dense_index(rows("x").limit(0), "w", "id")
    assert [tuple(r) for r in extend_index(empty, rows("q"), "w", "id").collect()] == [("q", 0, 1 if empty.count() else 0)]
