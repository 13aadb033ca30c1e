"""The data model: a sparse tensor is a DataFrame of mode columns plus one
double value column (``product`` by default, last by convention).

A matrix is the 3-column case ``(_1, _2, product)``.  Absent cells are zero:
only stored cells take part in joins and sums.  Dimension sizes are never
stored; they are ``max(index) + 1``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import VALUE


def modes_of(df: DataFrame, value: str = VALUE) -> list[str]:
    """Mode columns in column order (every column but the value)."""
    if value not in df.columns:
        raise ValueError(f"value column {value!r} not in {df.columns}")
    return [c for c in df.columns if c != value]


def tensor_shape(df: DataFrame, value: str = VALUE) -> DataFrame:
    """One row: ``max(mode) + 1`` per mode, under the mode's own name (D-5).

    One pass with a partial aggregate per task; null when the tensor is empty.
    """
    return df.agg(*[(F.max(m) + F.lit(1)).alias(m) for m in modes_of(df, value)])


def shape_of(df: DataFrame, value: str = VALUE) -> list[int]:
    """The shape as Python ints (a one-row collect; empty tensor -> zeros)."""
    row = tensor_shape(df, value).first()
    return [int(x) if x is not None else 0 for x in row]


def dense_size(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, [c.cast("double") for c in cols])


def nnz_density(df: DataFrame, value: str = VALUE) -> DataFrame:
    """nnz, dense cell count of the bounding grid and density (D-8)."""
    modes = modes_of(df, value)
    dims = [(F.max(m) + 1).cast("double") for m in modes]
    out = df.agg(F.count(F.lit(1)).alias("nnz"), *[d.alias(f"__d{i}") for i, d in enumerate(dims)])
    dense = dense_size([F.col(f"__d{i}") for i in range(len(modes))])
    return out.select(
        F.col("nnz"),
        dense.alias("dense_cells"),
        F.try_divide(F.col("nnz").cast("double"), dense).alias("density"),
    )
