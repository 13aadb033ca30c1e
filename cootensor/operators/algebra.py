"""Sparse tensor algebra as joins and aggregations (2.C, 2.D, 2.I).

Every product is ``join on the contracted index -> multiply -> group by the
surviving indices -> sum``; Catalyst adds the map-side partial sum.  Factors
(rank x dimension) are broadcast only after their size is checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import TILE_DIM, VALUE
from ..tensor import modes_of
from .dense import fiber_cross, fiber_gram
from .joins import fits_broadcast, prepare_factor, sized_broadcast


def ttm(t: DataFrame, factor: DataFrame, mode: str, value: str = VALUE,
        broadcast: bool | str = "auto") -> DataFrame:
    """Mode-n product ``T x_n F``.

    ``factor`` is ``(_1 = new index, _2 = old index, value)``.  T's ``mode``
    joins F's ``_2``; the new index is F's ``_1``; the mode keeps its name and
    position.  No unfold/fold round trip: one join and one aggregate.
    """
    modes = modes_of(t, value)
    if mode not in modes:
        raise ValueError(f"{mode!r} is not a mode of {modes}")
    f = factor.select(F.col("_1").alias("__out"), F.col("_2").alias("__in"),
                      F.col(factor.columns[2]).cast("double").alias("__w"))
    f = sized_broadcast(f, broadcast)
    j = t.join(f, t[mode] == f["__in"])
    keys = [F.col("__out").alias(m) if m == mode else F.col(m) for m in modes]
    out = j.groupBy(*keys).agg(F.sum(F.col(value) * F.col("__w")).alias(value))
    return out.select(*modes, value)


# Largest product of factor fan-outs (rows per input index) that a fused chain
# may expand a cell into before its single aggregation.
FUSE_MAX_FANOUT = 4


def ttm_fused(t: DataFrame, pairs: list[tuple[str, DataFrame]], value: str = VALUE,
              broadcast: bool | str = "auto") -> DataFrame:
    """Several mode products in one pass: every factor joins (broadcast after
    its size check) inside one pipeline, weights multiply, and one aggregation
    (one shuffle) sums over all contracted indices together.  Equal to the
    sequential chain by associativity; pays off when each cell expands into
    few rows (low fan-out), since the sequential chain shuffles once per mode.
    """
    modes = modes_of(t, value)
    j = t
    w = F.col(value)
    outs = {}
    for k, pair in enumerate(pairs):
        m, f = pair[0], pair[1]
        b = pair[2] if len(pair) > 2 else broadcast
        fk = f.select(F.col("_1").alias(f"__o{k}"), F.col("_2").alias(f"__i{k}"),
                      F.col(f.columns[2]).cast("double").alias(f"__w{k}"))
        fk = sized_broadcast(fk, b)
        j = j.join(fk, j[m] == fk[f"__i{k}"])
        w = w * F.col(f"__w{k}")
        outs[m] = f"__o{k}"
    keys = [F.col(outs[m]).alias(m) if m in outs else F.col(m) for m in modes]
    return j.groupBy(*keys).agg(F.sum(w).alias(value)).select(*modes, value)


def _fuse_groups(prepared, max_fanout: int):
    """Greedy runs of consecutive products whose fan-out product stays small."""
    groups, cur, prod = [], [], 1
    for m, f, b, fo in prepared:
        fo = max(fo, 1)
        if cur and prod * fo > max_fanout:
            groups.append(cur)
            cur, prod = [], 1
        cur.append((m, f, b))
        prod *= fo
    if cur:
        groups.append(cur)
    return groups


def _chain_order(t: DataFrame, pairs: list[tuple[str, DataFrame]], value: str) -> list[tuple[str, DataFrame]]:
    """Order mode products by shrink ratio (old dim / new dim), largest first.

    Legal only for the plain linear chain: the products on distinct modes
    commute.  Costs two one-row aggregates per factor.
    """
    dims = t.agg(*[(F.max(m) + 1).alias(m) for m, _ in pairs]).first()
    ratios = []
    for m, f in pairs:
        r = f.agg((F.max("_1") + 1).alias("r")).first()["r"] or 1
        ratios.append((dims[m] or 1) / r)
    order = sorted(range(len(pairs)), key=lambda i: -ratios[i])
    return [pairs[i] for i in order]


def ttm_chain(t: DataFrame, factors: list[DataFrame | None], skip: int | None = None,
              value: str = VALUE, top_k: int | None = None, threshold: float | None = None,
              checkpoint: bool = False, reorder: bool = False,
              broadcast: bool | str = "auto", fuse: bool = True) -> DataFrame:
    """``T x_1 F_1 ... x_N F_N`` in column order.

    Factors pair with modes by position (surplus modes untouched, ``None``
    skips a mode, so does ``skip``).  After each product the optional
    ``threshold`` (strict ``abs > p``) and ``top_k`` truncation apply (S8),
    and ``checkpoint`` cuts the lineage in the shared checkpoint folder.
    The reference's persisted chain is ``top_k=defaults.CORE_TOP_ROWS,
    checkpoint=True``.
    Without those, ``fuse`` merges runs of low fan-out products into one join
    pipeline and one shuffle (``ttm_fused``).
    """
    from .truncate import sparsify, top_k as _top_k

    modes = modes_of(t, value)
    pairs = [(m, f) for i, (m, f) in enumerate(zip(modes, factors))
             if f is not None and i != skip]
    if reorder and threshold is None and top_k is None and len(pairs) > 1:
        pairs = _chain_order(t, pairs, value)
    out = t
    plain = threshold is None and top_k is None and not checkpoint
    if fuse and plain and len(pairs) > 1:
        # one job per factor: cache it, count it, measure its fan-out
        prepared = [(m,) + prepare_factor(f, broadcast) for m, f in pairs]
        for group in _fuse_groups(prepared, FUSE_MAX_FANOUT):
            out = (ttm(out, group[0][1], group[0][0], value, group[0][2]) if len(group) == 1
                   else ttm_fused(out, group, value))
        return out
    for m, f in pairs:
        out = ttm(out, f, m, value, broadcast)
        if threshold is not None:
            out = sparsify(out, threshold, value)
        if checkpoint:
            out = out.checkpoint(eager=True)
        if top_k is not None:
            out = _top_k(out, top_k, value)
            if checkpoint:
                out = out.checkpoint(eager=True)
    return out


def _pick_broadcast(a: DataFrame, b: DataFrame, broadcast: bool | str):
    """Broadcast B when its size check passes, else try A; with neither small
    the join shuffles both sides (AQE splits skewed keys)."""
    if broadcast != "auto":
        return a, sized_broadcast(b, broadcast)
    if fits_broadcast(b):
        return a, F.broadcast(b)
    return sized_broadcast(a, "auto"), b


def spmm_atb(a: DataFrame, b: DataFrame, broadcast: bool | str = "auto") -> DataFrame:
    """``AᵀB``: contract the first column of both.

    Output ``(_1 = A's 2nd, _2 = B's 2nd, product)``.  Keys may be ints,
    strings, arrays or structs: Spark joins and groups them alike.
    """
    a2 = a.select(F.col(a.columns[0]).alias("__k"), F.col(a.columns[1]).alias("_1"),
                  F.col(a.columns[2]).cast("double").alias("__v"))
    b2 = b.select(F.col(b.columns[0]).alias("__k"), F.col(b.columns[1]).alias("_2"),
                  F.col(b.columns[2]).cast("double").alias("__w"))
    a2, b2 = _pick_broadcast(a2, b2, broadcast)
    return (a2.join(b2, "__k").groupBy("_1", "_2")
            .agg(F.sum(F.col("__v") * F.col("__w")).alias(VALUE)))


def spmm_abt(a: DataFrame, b: DataFrame, broadcast: bool | str = "auto") -> DataFrame:
    """``ABᵀ``: contract the second column of both (S3).

    Output keeps A's and B's first-column names (B's gets ``_r`` appended when
    they clash, so names stay distinct — D10).
    """
    na, nb = a.columns[0], b.columns[0]
    if nb == na:
        nb = nb + "_r"
    a2 = a.select(F.col(a.columns[1]).alias("__k"), F.col(a.columns[0]).alias(na),
                  F.col(a.columns[2]).cast("double").alias("__v"))
    b2 = b.select(F.col(b.columns[1]).alias("__k"), F.col(b.columns[0]).alias(nb),
                  F.col(b.columns[2]).cast("double").alias("__w"))
    a2, b2 = _pick_broadcast(a2, b2, broadcast)
    return (a2.join(b2, "__k").groupBy(na, nb)
            .agg(F.sum(F.col("__v") * F.col("__w")).alias(VALUE)))


def matrix_add(*ms: DataFrame) -> DataFrame:
    """Sum of sparse matrices: union all + sum by ``(_1, _2)`` (D-4)."""
    norm = [m.select(F.col(m.columns[0]).alias("_1"), F.col(m.columns[1]).alias("_2"),
                     F.col(m.columns[2]).cast("double").alias(VALUE)) for m in ms]
    u = reduce(DataFrame.unionByName, norm)
    return u.groupBy("_1", "_2").agg(F.sum(VALUE).alias(VALUE))


def mode_marginal(t: DataFrame, mode: str, value: str = VALUE) -> DataFrame:
    """Sum of the tensor over every mode but ``mode`` (D-3)."""
    return t.groupBy(mode).agg(F.sum(value).alias(value))


def gram(u: DataFrame, upper_only: bool = False, tile: int = TILE_DIM) -> DataFrame:
    """Gram ``U Uᵀ`` of an unfolding ``(key, idx, value)`` over its index.

    Result ``(_1, _2, product)``, symmetric; ``upper_only`` keeps ``_1 <= _2``.
    """
    return fiber_gram(u, tile=tile, upper_only=upper_only)


def cross_moment(a: DataFrame, b: DataFrame, tile: int = TILE_DIM) -> DataFrame:
    """``A Bᵀ`` for two unfoldings keyed by the same other-mode key."""
    return fiber_cross(a, b, tile=tile)
