"""Affine mode products: W·T plus a bias per output index.

A regression factor B is a matrix with ``_1`` = output index, ``_2 = 0`` the
bias and ``_2 = j + 1`` the weight of input index j.  The bias is added only
to cells the product produced, and an output index with no bias row drops its
cells (inner join, S6).  The magnitude threshold applies before the bias in
the fit path and after it in prediction (S7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import CHAIN_PRECISION, MODE_PRECISION, PREDICT_PRECISION
from ..functions.expr import above
from ..session import VALUE
from ..tensor import modes_of
from .joins import sized_broadcast
from .reshape import bias_split


def affine_ttm(t: DataFrame, b: DataFrame, mode: str, precision: float | None = MODE_PRECISION,
               threshold: str = "before", value: str = VALUE,
               broadcast: bool | str = "auto") -> DataFrame:
    """``T x_mode W + bias``.  ``threshold`` is ``"before"`` (fit path) or
    ``"after"`` (prediction); ``precision=None`` disables it."""
    modes = modes_of(t, value)
    bias, w = bias_split(b, mode)
    wf = sized_broadcast(w.select(F.col("_1").alias("__out"), F.col("_2").alias("__in"),
                                  F.col(VALUE).alias("__w")), broadcast)
    j = t.join(wf, t[mode] == wf["__in"])
    keys = [F.col("__out").alias(m) if m == mode else F.col(m) for m in modes]
    prod = j.groupBy(*keys).agg(F.sum(F.col(value) * F.col("__w")).alias(value))
    if precision is not None and threshold == "before":
        prod = prod.filter(above(value, precision))
    out = (prod.join(sized_broadcast(bias, broadcast), mode)
           .withColumn(value, F.col(value) + F.col("bias")).select(*modes, value))
    if precision is not None and threshold == "after":
        out = out.filter(above(value, precision))
    return out


def affine_chain(t: DataFrame, bs: list[DataFrame], skip: int, precision: float | None = CHAIN_PRECISION,
                 prefix: DataFrame | None = None, value: str = VALUE, checkpoint: bool = False,
                 broadcast: bool | str = "auto") -> DataFrame:
    """Affine products on every mode after ``skip`` (I7), threshold before bias.

    ``prefix`` is ``t`` with the modes before ``skip`` already multiplied (the
    reference keeps it as a file; here it is an explicit DataFrame, usually a
    checkpoint).  Without a prefix the chain starts from ``t``.
    """
    modes = modes_of(t, value)
    out = prefix if prefix is not None else t
    for i, (m, b) in enumerate(zip(modes, bs)):
        if i > skip and b is not None:
            out = affine_ttm(out, b, m, precision, "before", value, broadcast)
            if checkpoint:
                out = out.checkpoint(eager=True)
    return out


def predict(x: DataFrame, bs: list[DataFrame], precision: float | None = PREDICT_PRECISION,
            value: str = VALUE, checkpoint: bool = False, broadcast: bool | str = "auto") -> DataFrame:
    """Apply every factor to its mode (the free mode, last, is never touched),
    threshold after the bias (I8)."""
    modes = modes_of(x, value)[:-1]
    out = x
    for m, b in zip(modes, bs):
        if b is None:
            continue
        out = affine_ttm(out, b, m, precision, "after", value, broadcast)
        if checkpoint:
            out = out.checkpoint(eager=True)
    return out
