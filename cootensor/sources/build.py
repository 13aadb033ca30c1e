"""Building tensors from fact tables (M1, M2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import sized_broadcast
from ..session import VALUE

_POS_BITS = 33  # monotonically_increasing_id = partition id << 33 | row position


def dense_index(values: DataFrame, col: str, out: str | None = None, dtype: str = "int") -> DataFrame:
    """Dictionary ``(col, out)``: 0-based rank of each distinct value of ``col``.

    A null label is a label like any other and ranks last.  The distinct
    values are range-partitioned and sorted, each row's position in its
    partition and the partition number come from
    ``monotonically_increasing_id``, and a per-partition count (one row per
    partition) gives the offsets, so no task ranks the whole dictionary.  The
    sorted dictionary is checkpointed: ids stay stable between the count and
    the lookup, also after a task retry.
    """
    out = out or col
    d = values.select(col).distinct().orderBy(F.col(col).asc_nulls_last())
    d = d.withColumn("__mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    d = d.withColumn("__pid", F.shiftright("__mid", _POS_BITS)).withColumn(
        "__pos", F.col("__mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
    counts = d.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offs = counts.select("__pid", F.coalesce(F.sum("__n").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return d.join(F.broadcast(offs), "__pid").select(
        F.col(col), (F.col("__off") + F.col("__pos")).cast(dtype).alias(out))


def extend_index(known: DataFrame, values: DataFrame, col: str, out: str, version: str = "version") -> DataFrame:
    """A dictionary ``(col, out, version)`` with the labels of ``values`` that ``known`` lacks appended (M1).

    Ids given before never change, so tensors indexed with an older version stay
    valid.  New labels (a null-safe anti join) get the ids after the largest known,
    in label order, as longs, and the version after the latest.  ``known`` is a
    dictionary of ``dense_index`` (version 0) or of an earlier call.
    """
    if version not in known.columns:
        known = known.withColumn(version, F.lit(0))
    known = known.select(col, F.col(out).cast("long").alias(out), F.col(version).cast("int").alias(version)).checkpoint(eager=True)
    top = known.agg(F.max(out).alias("id"), F.max(version).alias("v")).first()
    mine = known.select(F.col(col).alias("__label"))
    fresh = values.select(col).distinct().join(mine, F.col(col).eqNullSafe(F.col("__label")), "left_anti")
    ids = dense_index(fresh, col, out, "long")
    first = 0 if top["id"] is None else top["id"] + 1
    v = 0 if top["v"] is None else top["v"] + 1
    return known.unionByName(ids.select(col, (F.col(out) + F.lit(first)).alias(out), F.lit(v).alias(version)))


def lookup_index(df: DataFrame, d: DataFrame, col: str, out: str, broadcast: bool | str = "auto") -> DataFrame:
    """``df`` with the index ``out`` of its label ``col`` in place of it; null labels match null."""
    d = sized_broadcast(d.select(F.col(col).alias("__label"), F.col(out).alias("__idx")), broadcast)
    return df.join(d, F.col(col).eqNullSafe(F.col("__label"))).drop("__label", col).withColumnRenamed("__idx", out)


def index_modes(df: DataFrame, modes: list[str], value: str = VALUE,
                broadcast: bool | str = "auto",
                checkpoint: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace label modes by 0-based ints (M1).

    Returns the indexed frame and the dictionaries ``{mode: (mode, mode_idx)}``
    that map back.  Each dictionary is broadcast only when its size is
    checked small; otherwise the join shuffles (AQE splits skewed keys).
    """
    if checkpoint and len(modes) > 0:
        df = df.checkpoint(eager=True)      # read once per dictionary and once for the join
    dicts = {}
    out = df
    for m in modes:
        d = dense_index(df, m, f"{m}__idx")
        dicts[m] = d
        out = lookup_index(out, d, m, f"{m}__idx", broadcast).withColumnRenamed(f"{m}__idx", m)
    return out.select(*df.columns), dicts


def decode_modes(t: DataFrame, dicts: dict[str, DataFrame], broadcast: bool | str = "auto") -> DataFrame:
    """Map indexed modes back to their labels with the dictionaries returned
    by ``index_modes`` (M1, the way back).  Column order is kept; an index
    without a label becomes null."""
    out = t
    for m, d in dicts.items():
        lab = d.select(F.col(f"{m}__idx").alias(m), F.col(m).alias(f"{m}__label"))
        out = out.join(sized_broadcast(lab, broadcast), m, "left").withColumn(m, F.col(f"{m}__label")).drop(f"{m}__label")
    return out.select(*t.columns)


def build_tensor(df: DataFrame, modes: list, value, agg: str = "sum",
                 drop_zero: bool = True, value_type: str | None = None) -> DataFrame:
    """Aggregate a fact table into a sparse tensor (M2).

    ``modes`` are column names or aliased expressions, ``value`` a column name
    or expression.  ``value_type`` (e.g. ``decimal(18,2)``) makes the sum
    exact before the cast to double.  Partial aggregation runs before the
    shuffle, so a hot key costs one row per task.
    """
    v = F.col(value) if isinstance(value, str) else value
    if value_type:
        v = v.cast(value_type)
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[agg]
    out = df.groupBy(*modes).agg(fn(v).cast("double").alias(VALUE))
    if drop_zero:
        out = out.filter(F.col(VALUE) != 0)
    return out
