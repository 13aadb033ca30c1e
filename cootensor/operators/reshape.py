"""Projections, filters and reshaping (2.B, F2).  All narrow, Catalyst-visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import VALUE
from ..tensor import modes_of


def rename_modes(df: DataFrame, names: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Positional rename (B1): modes become ``_1.._N`` (or ``names``), the
    last column becomes ``product``."""
    cols = df.columns
    src_value = value or cols[-1]
    src_modes = [c for c in cols if c != src_value]
    new = names or [f"_{i + 1}" for i in range(len(src_modes))]
    if len(new) != len(src_modes):
        raise ValueError("one name per mode")
    return df.select(*[F.col(c).alias(n) for c, n in zip(src_modes, new)],
                     F.col(src_value).cast("double").alias(VALUE))


def key_name(others: list[str]) -> str:
    return "+".join(others)


def unfold(t: DataFrame, mode: str, value: str = VALUE) -> DataFrame:
    """Mode-n matricization (B17): ``(key, mode, value)``.

    The key is a struct of the other modes (native types and names kept), in
    column order, named by joining their names with ``+``.
    """
    modes = modes_of(t, value)
    others = [m for m in modes if m != mode]
    key = F.struct(*[F.col(m) for m in others]) if others else F.struct(F.lit(0).alias("__none"))
    return t.select(key.alias(key_name(others) or "__none"), F.col(mode), F.col(value))


def fold(u: DataFrame, columns: list[str]) -> DataFrame:
    """Inverse of ``unfold`` (B18): restore the modes and the original column
    order ``columns`` (modes and value, as before unfolding).  Any arity."""
    key, mode, value = u.columns[:3]
    fields = [c for c in key.split("+") if c and c != "__none"]
    flat = u.select(*[F.col(key)[f].alias(f) for f in fields], F.col(mode), F.col(value))
    return flat.select(*columns)


def transpose(m: DataFrame) -> DataFrame:
    """Swap ``_1`` and ``_2``."""
    return m.select(F.col("_2").alias("_1"), F.col("_1").alias("_2"), F.col(m.columns[2]))


def vstack(*ms: DataFrame, tag: str = "MATRIX_ID") -> DataFrame:
    """Tagged vertical stack (F2): input i gets ``tag = i`` (first column)."""
    cols = ms[0].columns
    parts = [m.select(F.lit(i).alias(tag), *[F.col(c) for c in cols]) for i, m in enumerate(ms)]
    return reduce(DataFrame.unionByName, parts)


def collapse_modes(t: DataFrame, modes: list[str], value: str = VALUE, aggregate: bool = True) -> DataFrame:
    """Set ``modes`` to index 0 (B12); with ``aggregate`` the duplicates this
    creates are summed (fixes D8), else they stay as separate rows."""
    cols = modes_of(t, value)
    out = t.withColumns({m: F.lit(0).cast(t.schema[m].dataType) for m in modes})
    if aggregate:
        out = out.groupBy(*cols).agg(F.sum(value).alias(value))
    return out.select(*cols, value)


def rebase(t: DataFrame, mode: str, by: DataFrame | None = None) -> DataFrame:
    """Shift ``mode`` so its minimum is 0.

    The minimum comes from ``by`` (default ``t``) as a scalar subquery: Spark
    runs the one-row aggregate and inlines it, no collect and no cross join.
    """
    src = by if by is not None else t
    mn = src.select(F.min(mode)).scalar()
    return t.withColumn(mode, (F.col(mode) - mn).cast(t.schema[mode].dataType))


def bias_encode(m: DataFrame, shift: int = 1) -> DataFrame:
    """Shift the second index by ``shift`` (B5): +1 makes room for the bias
    column 0 of a regression factor, -1 undoes it."""
    return m.withColumn("_2", F.col("_2") + F.lit(shift))


def bias_split(b: DataFrame, mode: str = "_1") -> tuple[DataFrame, DataFrame]:
    """Split a regression factor (B10): ``_2 = 0`` is the bias of output index
    ``_1``; ``_2 = j+1`` is the weight of input index j.

    Returns ``(bias(mode, bias), weights(_1, _2, product))``.
    """
    v = b.columns[2]
    bias = b.filter(F.col("_2") == 0).select(F.col("_1").alias(mode), F.col(v).alias("bias"))
    w = b.filter(F.col("_2") > 0).select(F.col("_1"), (F.col("_2") - 1).alias("_2"), F.col(v).alias(VALUE))
    return bias, w


def time_slice(t: DataFrame, mode: str, lo=None, hi=None, lo_inclusive: bool = False,
               hi_inclusive: bool = False) -> DataFrame:
    """Range filter on one mode (B7); pushed to the Parquet scan."""
    c = F.col(mode)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((c >= lo) if lo_inclusive else (c > lo))
    if hi is not None:
        cond = cond & ((c <= hi) if hi_inclusive else (c < hi))
    return t.filter(cond)


def cell_lookup(t: DataFrame, coords: dict) -> DataFrame:
    """Conjunctive point lookup of one cell."""
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in coords.items()])
    return t.filter(cond)
