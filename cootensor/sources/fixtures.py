"""Tensors and factors built from the driver's tables (FIXTURES.md §2, §3).

Everything here reads the given Parquet tables, so its work grows with them.
Tensors built through dictionaries are materialized (checkpoint) once: every
factor later derived from them then starts from that copy instead of
repeating the dictionary joins in its own plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import VALUE
from .build import build_tensor, dense_index, lookup_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Month numbering origin (year 1995, month 1 -> m = 0) and the
# day origin of the events tensor.
MONTH_ORIGIN_YEAR = 1995
DAY_ORIGIN = "2024-01-01"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cn, sn, m, product)``: quantity by customer nation x supplier nation
    x month.  Integer-valued, so every later sum is exact."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(c, F.col("o_custkey") == c.c_custkey)
         .join(s, F.col("l_suppkey") == s.s_suppkey))
    m = ((F.year("o_orderdate") - MONTH_ORIGIN_YEAR) * 12 + F.month("o_orderdate") - 1).cast("int")
    return build_tensor(j, [F.col("c_nationkey").cast("int").alias("cn"),
                            F.col("s_nationkey").cast("int").alias("sn"), m.alias("m")], "l_quantity")


def _day(ts: str) -> F.Column:
    return F.datediff(F.to_date(F.col(ts)), F.lit(DAY_ORIGIN).cast("date")).cast("int")


def events_ued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(u, e, d, product)``: user rank x event-type rank x day, exact sum of
    ``value`` (decimal(18,2)) as double.  Aggregated on the raw labels first,
    then the (much smaller) cell table is mapped to indices."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value")
    cells = build_tensor(ev, ["user_id", "event_type", _day("ts").alias("d")], "value",
                         value_type="decimal(18,2)").checkpoint(eager=True)
    users = dense_index(cells, "user_id", "u")
    types = dense_index(cells, "event_type", "e")
    out = lookup_index(lookup_index(cells, users, "user_id", "u"), types, "event_type", "e").select("u", "e", "d", VALUE)
    return out.checkpoint(eager=True)       # materialized once; later plans start from it


def events_ed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(e, d, product)``: event type x day, exact decimal sum over users."""
    ev = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    cells = build_tensor(ev, ["event_type", _day("ts").alias("d")], "value",
                         value_type="decimal(18,2)").checkpoint(eager=True)
    types = dense_index(cells, "event_type", "e")
    out = lookup_index(cells, types, "event_type", "e").select("e", "d", VALUE)
    return out.checkpoint(eager=True)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(b, t, f, s, product)``: brand x type x return flag x line status."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    cells = build_tensor(li.join(p, li.l_partkey == p.p_partkey),
                         ["p_brand", "p_type", "l_returnflag", "l_linestatus"], "l_quantity")
    cells = cells.checkpoint(eager=True)
    out = cells
    for src, dst in [("p_brand", "b"), ("p_type", "t"), ("l_returnflag", "f"), ("l_linestatus", "s")]:
        out = lookup_index(out, dense_index(cells, src, dst), src, dst)
    return out.select("b", "t", "f", "s", VALUE).checkpoint(eager=True)


def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(i, j, product)``: vector x position of the embeddings (float -> double)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = e.select(F.col("vec_id").cast("int").alias("i"), F.posexplode("embedding").alias("j", "x"))
    return out.select("i", F.col("j").cast("int").alias("j"),
                      F.col("x").cast("double").alias(VALUE)).filter(F.col(VALUE) != 0)


# ---- factors (FIXTURES.md §3); all derived from tables or from a tensor ----

def nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_1 = n_regionkey, _2 = n_nationkey, 1.0`` (5 x 25)."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_regionkey").cast("int").alias("_1"),
                    F.col("n_nationkey").cast("int").alias("_2"), F.lit(1.0).alias(VALUE))


def month_year(t: DataFrame, mode: str = "m") -> DataFrame:
    """``_1 = m div 12, _2 = m, 1.0`` over the months present in ``t``."""
    ms = t.select(F.col(mode).alias("_2")).distinct()
    return ms.select(F.floor(F.col("_2") / 12).cast("int").alias("_1"), F.col("_2"), F.lit(1.0).alias(VALUE))


def shifted_identity_bias(t: DataFrame, mode: str) -> DataFrame:
    """Regression factor over the indices ``i`` of ``mode``: bias ``i + 1`` in
    column 0 and weight 1.0 at column ``i + 1``."""
    idx = t.select(F.col(mode).alias("_1")).distinct()
    return idx.select("_1", F.inline(F.array(
        F.struct(F.lit(0).alias("_2"), (F.col("_1") + 1).cast("double").alias(VALUE)),
        F.struct((F.col("_1") + 1).alias("_2"), F.lit(1.0).alias(VALUE)))))


# Lag weights of FIXTURES.md §3 (target 0; bias 0.0; lags 0-2).
LAG_WEIGHTS = [(0, 0, 0.0), (0, 1, 0.5), (0, 2, 0.25), (0, 3, 0.25)]


def lag_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAG_WEIGHTS, "_1 int, _2 int, product double")
