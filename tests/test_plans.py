"""Plan-shape checks: the physical plans we want at scale."""

import __spark_entry__ as E


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SF = "/root/testdata/sf0.001"


def test_ttm_broadcasts_checked_factor_and_stays_in_jvm(spark):
    p = plan(E.queries()["ttm"](spark, SF))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p
    for py in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "FlatMapGroupsInPandas", "MapInPandas"):
        assert py not in p


def test_e_class_chains_have_no_python(spark):
    for name in ("ttm_chain", "spmm_atb", "affine_chain", "lag_expand", "r2_score"):
        p = plan(E.queries()[name](spark, SF))
        for py in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "FlatMapGroupsInPandas"):
            assert py not in p, (name, py)


def test_scan_pushes_filter_and_prunes(spark, tmp_path):
    from cootensor import operators as op
    from cootensor.sources import fixtures as fx, read_tensor
    path = str(tmp_path / "trade")
    fx.trade(spark, SF).write.parquet(path)
    df = op.time_slice(read_tensor(spark, path, ["sn", "m", "product"]), "m", hi=24)
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(m), LessThan(m,24)]" in s
    assert "ReadSchema: struct<sn:int,m:int,product:double>" in s        # cn never read


def test_top_k_is_take_ordered_not_global_window(spark):
    p = plan(E.queries()["topk_core"](spark, SF))
    assert "TakeOrderedAndProject" in p
    assert "Window" not in p


def test_lag_expand_is_one_scan(spark):
    p = plan(E.queries()["lag_expand"](spark, SF))
    assert "Union" not in p and "Generate" in p


def test_complete_times_is_broadcast_semi_join(spark):
    from cootensor import operators as op
    from cootensor.sources import fixtures as fx
    x, _ = op.xy_split(op.lag_expand(fx.events_ed(spark, SF), "d", 4), "d", "lag", 4)
    p = plan(x)
    assert "LeftSemi" in p and "BroadcastHashJoin" in p and "SortMergeJoin" not in p
