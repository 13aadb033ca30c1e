"""Column expressions shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the integer LCG used for reproducible "random" matrices
# (identical in Spark and in the DuckDB oracle; bigint arithmetic).
LCG_A = 1103515245
LCG_C = 12345
LCG_M = 2147483647

_MASK53 = (1 << 53) - 1


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def above(value: str | Column, precision: float) -> Column:
    """Sparsify predicate: strict ``abs(v) > p``."""
    return F.abs(col_of(value)) > F.lit(float(precision))


def hash_uniform(seed: int, *coords: str | Column) -> Column:
    """Uniform [0, 1) from a seeded xxhash64 of the coordinates.

    Depends only on (seed, coordinates): the same on every partitioning and on
    recomputation after an executor loss, unlike an unseeded ``rand()``.
    """
    h = F.xxhash64(F.lit(int(seed)), *[col_of(c) for c in coords])
    return h.bitwiseAND(F.lit(_MASK53)).cast("double") / F.lit(float(1 << 53))


def lcg_uniform(i: str | Column, j: str | Column, seed: int) -> Column:
    """((i*A + j*C + seed) mod M) / M with bigint arithmetic."""
    ii = col_of(i).cast("bigint")
    jj = col_of(j).cast("bigint")
    return ((ii * F.lit(LCG_A) + jj * F.lit(LCG_C) + F.lit(int(seed))) % F.lit(LCG_M)).cast("double") / F.lit(float(LCG_M))
