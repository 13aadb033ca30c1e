"""Driver contract: entry() and every registered query against its DuckDB oracle."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["cn", "sn", "m", "product"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


FAST = ["ttm", "ttm_chain", "gram", "topk_core", "lag_xy_split", "affine_chain", "predict_tensor",
        "r2_score", "recon_mse", "normal_equations", "ridge_solve", "regression_step", "gram_eigvec",
        "spmm_composite_key", "index_modes", "tucker_reconstruct"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts"))
    from check_oracle import frame_hash
    s = E.queries()[name](spark, SF).toPandas()
    d = con.sql(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert frame_hash(s) == frame_hash(d)
