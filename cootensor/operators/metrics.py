"""Scores: R² of a prediction and reconstruction MSE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import VALUE
from ..tensor import modes_of


def r2(y: DataFrame, pred: DataFrame, min_pred: float | None = None, positive_only: bool = True,
       value: str = VALUE) -> DataFrame:
    """R² over the inner join of target and prediction.

    ``min_pred`` keeps predictions ``>= min_pred`` before the join (the
    reference's in-loop ``>= 1``), ``positive_only`` keeps ``pred > 0`` after.
    ȳ is over the joined rows.  ``SS_tot = var_pop(y) * n`` (one pass, no
    Σy² − nȳ² cancellation); R² is null when SS_tot is 0 or nothing joins.
    """
    modes = modes_of(y, value)
    p = pred.withColumnRenamed(value, "__pred")
    if min_pred is not None:
        p = p.filter(F.col("__pred") >= min_pred)
    j = y.join(p, modes)
    if positive_only:
        j = j.filter(F.col("__pred") > 0)
    agg = j.agg(F.sum(F.pow(F.col(value) - F.col("__pred"), 2)).alias("ss_res"),
                (F.var_pop(value) * F.count(F.lit(1))).alias("ss_tot"),
                F.count(F.lit(1)).alias("n"))
    return agg.select("ss_res", "ss_tot",
                      (F.lit(1.0) - F.try_divide(F.col("ss_res"), F.col("ss_tot"))).alias("r2"), "n")


def mse(t: DataFrame, rec: DataFrame, how: str = "inner", value: str = VALUE) -> DataFrame:
    """Mean squared difference (S21).  ``how="inner"`` averages over cells in
    both tensors (reference); ``"outer"`` counts a missing cell as 0, giving
    the true squared Frobenius error per stored cell of the union."""
    modes = modes_of(t, value)
    j = t.join(rec.withColumnRenamed(value, "__rec"), modes, how)
    d = F.coalesce(F.col(value), F.lit(0.0)) - F.coalesce(F.col("__rec"), F.lit(0.0))
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(d, 2)).alias("mse"))


def frobenius_mse(t: DataFrame, g: DataFrame, factors: list[DataFrame], value: str = VALUE) -> DataFrame:
    """Mean squared error of a Tucker model over its whole grid (J10, D8), without building the grid.

    ``||T - G x F||² = ||T||² - 2 <T x Fᵀ.., G> + <G x (F Fᵀ).., G>``: the middle term
    needs the projected core, the last the rank x rank products of each factor.  The
    grid is the factors' index ranges (``max + 1``); cells of T must lie inside it.
    Returns ``(n, sse, mse)``.  The three terms cancel, so ``sse`` has an error of some
    1e-15 of ``||T||²``.
    """
    from .algebra import spmm_abt, ttm_chain

    modes = modes_of(g, value)
    cast = t.withColumn(value, F.col(value).cast("double"))
    core = ttm_chain(cast, factors, value=value).toDF(*modes, "__p")
    own = ttm_chain(g, [spmm_abt(f.toDF("_1", "_2", value), f.toDF("_1", "_2", value)).toDF("_1", "_2", value) for f in factors],
                    value=value).toDF(*modes, "__q")
    both = g.join(core, modes, "left").join(own, modes, "left")
    cross = both.agg(F.sum(F.col(value) * F.coalesce("__p", F.lit(0.0))).alias("tg"), F.sum(F.col(value) * F.coalesce("__q", F.lit(0.0))).alias("gg"))
    square = cast.agg(F.sum(F.col(value) * F.col(value)).alias("tt"))
    tt, n = square.scalar(), F.lit(1.0)
    for f in factors:
        n = n * f.select(F.max(f.columns[1]) + 1).scalar()
    sse = F.coalesce(tt, F.lit(0.0)) - 2 * F.coalesce("tg", F.lit(0.0)) + F.coalesce("gg", F.lit(0.0))
    return cross.select(n.cast("long").alias("n"), sse.alias("sse")).withColumn("mse", F.try_divide("sse", F.col("n").cast("double")))
