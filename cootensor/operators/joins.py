"""Join helpers: broadcast only what has a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS


def _row_bytes(df: DataFrame):
    """Bytes of a row as a broadcast relation holds it: 8 per fixed-width field, the written length of any other, 16 overhead."""
    total = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            total = total + F.lit(8)
        else:
            total = total + F.coalesce(F.octet_length(c if f.dataType.simpleString() in ("string", "binary")
                                                      else F.to_json(F.struct(c))), F.lit(0)) + F.lit(8)
    return total


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether ``df`` is small in rows and bytes.  Nothing is cached; at most ``max_rows + 1`` rows are looked at."""
    r = df.select(_row_bytes(df).alias("b")).limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return r["n"] <= max_rows and (r["b"] or 0) <= max_bytes


def sized_broadcast(df: DataFrame, broadcast: bool | str = "auto",
                    max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only when its size is known to be small.

    ``broadcast=True`` trusts the caller (a factor whose size is fixed by its
    rank and dimension); ``"auto"`` measures it first and leaves no cached
    frame behind (checkpoint a factor that is dear to derive); ``False``
    leaves the choice to Catalyst / AQE, which measures shuffle sizes at run
    time.
    """
    if broadcast is True or broadcast == "auto" and fits_broadcast(df, max_rows):
        return F.broadcast(df)
    return df


def factor_stats(f: DataFrame) -> tuple[int, int]:
    """``(rows, fan-out)`` of a factor in one aggregate: its row count and the
    most rows any input index ``_2`` maps to."""
    r = (f.groupBy("_2").agg(F.count(F.lit(1)).alias("__n"))
         .agg(F.sum("__n").alias("rows"), F.max("__n").alias("fan")).first())
    return int(r["rows"] or 0), int(r["fan"] or 0)


def prepare_factor(f: DataFrame, broadcast: bool | str = "auto",
                   max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, bool, int]:
    """Measure a factor once and decide its join strategy.

    Returns ``(factor, broadcast?, fan-out)``; the decision is a plain bool so
    later joins spend no further jobs on it.
    """
    rows, fan = factor_stats(f)
    b = (rows <= max_rows and fits_broadcast(f, max_rows)) if broadcast == "auto" else bool(broadcast)
    return f, b, fan
