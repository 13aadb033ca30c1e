"""Time-lag feature operators (2.H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import N_LAGS
from ..session import VALUE
from ..tensor import modes_of
from .reshape import collapse_modes, rebase, time_slice


def lag_expand(t: DataFrame, time: str | None = None, n_lags: int = N_LAGS, lag: str = "lag",
               value: str = VALUE) -> DataFrame:
    """Copy every cell to times ``t + k`` tagged ``lag = k``, ``k = 0..L-1``.

    One scan and an ``explode`` instead of a union of L scans.  The lag mode
    sits just before the time mode.
    """
    modes = modes_of(t, value)
    time = time or modes[-1]
    others = [m for m in modes if m != time]
    ks = F.explode(F.sequence(F.lit(0), F.lit(n_lags - 1))).alias(lag)
    e = t.select(*others, time, value, ks)
    e = e.withColumn(time, (F.col(time) + F.col(lag)).cast(t.schema[time].dataType))
    return e.select(*others, lag, time, value)


def complete_times(tl: DataFrame, time: str, lag: str = "lag", n_lags: int = N_LAGS) -> DataFrame:
    """Times that hold every lag ``0..L-1`` (H2): one aggregate, partial per task."""
    return (tl.groupBy(time).agg(F.count_distinct(lag).alias("__n"))
            .filter(F.col("__n") == n_lags).select(time))


def xy_split(tl: DataFrame, time: str, lag: str = "lag", n_lags: int = N_LAGS, target_lag: int | None = None,
             collapse: list[str] | None = None, value: str = VALUE,
             aggregate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Split a lag tensor into regression input X and target Y.

    Only complete times are kept (``left_semi``).  X holds every lag but the
    target lag; Y holds the target lag with ``collapse`` modes (default: the
    lag mode) set to 0.  ``target_lag`` defaults to ``L - 1`` as in the
    reference (the oldest observation); 0 gives forecasting.
    """
    from .joins import sized_broadcast
    target_lag = n_lags - 1 if target_lag is None else target_lag
    # one row per complete time: broadcast after its size check, so the lag
    # tensor is filtered in place instead of shuffled for a semi join
    done = sized_broadcast(complete_times(tl, time, lag, n_lags))
    kept = tl.join(done, time, "left_semi")
    x = kept.filter(F.col(lag) != target_lag)
    y = kept.filter(F.col(lag) == target_lag)
    y = collapse_modes(y, collapse if collapse is not None else [lag], value, aggregate)
    cols = modes_of(tl, value) + [value]
    return x.select(*cols), y.select(*cols)


def cut_and_rebase(x: DataFrame, y: DataFrame, time: str, after: int) -> tuple[DataFrame, DataFrame]:
    """Keep ``time > after`` in both and rebase by X's own minimum."""
    xc = time_slice(x, time, lo=after)
    yc = time_slice(y, time, lo=after)
    return rebase(xc, time, by=xc), rebase(yc, time, by=xc)
