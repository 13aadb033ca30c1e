"""Sources and sinks (2.A): Parquet and CSV tensors, literal factors, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import VALUE


def read_tensor(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of a tensor or factor (A1).  Projection and later filters
    reach the scan (``ReadSchema`` / ``PushedFilters``)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_tensor(df: DataFrame, path: str, mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Parquet sink (A2)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_csv_tensor(spark: SparkSession, path: str, n_modes: int, mode_type: str = "int",
                    names: list[str] | None = None) -> DataFrame:
    """Headerless CSV tensor (A3): positional columns ``_c0..`` become
    ``_1.._N`` (cast to ``mode_type``) and ``product`` (double).

    Read as strings and converted with ``try_cast``: a malformed field gives
    null instead of failing the job under ANSI mode.
    """
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(n_modes + 1)])
    raw = spark.read.schema(schema).csv(path, header=False)
    out = names or [f"_{i + 1}" for i in range(n_modes)]
    return raw.select(*[F.col(f"_c{i}").try_cast(mode_type).alias(out[i]) for i in range(n_modes)],
                      F.col(f"_c{n_modes}").try_cast("double").alias(VALUE))


def write_csv_tensor(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=False)


def literal_factor(spark: SparkSession, rows: list[tuple], names=("_1", "_2", VALUE),
                   schema: str | None = None) -> DataFrame:
    """Small local rows -> DataFrame (A4).  Only for fixed-size inputs (a
    handful of weights), never for data that grows."""
    schema = schema or ", ".join(
        [f"{n} int" for n in names[:-1]] + [f"{names[-1]} double"])
    return spark.createDataFrame(rows, schema)


_BLOCK = 1 << 16


def index_grid(spark: SparkSession, sizes: list[int], names: list[str]) -> DataFrame:
    """Dense index grid ``0..s_1-1 x ... x 0..s_n-1`` (A5).

    One ``range`` of the total cell count, decoded by div/mod (row-major, last
    name fastest): no join, partitioned like any range.
    """
    total = reduce(lambda a, b: a * b, sizes, 1)
    r = spark.range(total)
    cols = []
    stride = 1
    for s, n in reversed(list(zip(sizes, names))):
        cols.append(F.expr(f"cast((id div {stride}L) % {s}L as int)").alias(n))
        stride *= s
    return r.select(*reversed(cols))


def index_grid_df(sizes: DataFrame, names: list[str]) -> DataFrame:
    """Dense grid whose sizes come from a one-row DataFrame (columns ``names``),
    e.g. ``tensor_shape``; stays lazy and distributed via ``sequence`` +
    ``explode`` of the linear cell number.

    The linear numbers are generated in blocks of ``_BLOCK`` so that no single
    row explodes into more than ``_BLOCK`` cells.
    """
    total = reduce(lambda a, b: a * b, [F.col(n).cast("bigint") for n in names])
    blocks = sizes.select(total.alias("__total"), *[F.col(n).alias(f"__s_{n}") for n in names]).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                  F.greatest(F.lit(0).cast("bigint"),
                                             F.expr(f"(__total + {_BLOCK - 1}L) div {_BLOCK}L") - 1))).alias("__b"))
    blocks = blocks.repartition(F.col("__b"))
    cells = blocks.select("*", F.explode(F.sequence(
        F.col("__b") * _BLOCK,
        F.least(F.col("__b") * _BLOCK + _BLOCK, F.col("__total")) - 1)).alias("__id")).filter(
        (F.col("__id") >= 0) & (F.col("__id") < F.col("__total")))
    cols = []
    stride = "1L"
    for n in reversed(names):
        cols.append(F.expr(f"cast((__id div ({stride})) % `__s_{n}` as int)").alias(n))
        stride += f" * `__s_{n}`"
    return cells.select(*reversed(cols))

