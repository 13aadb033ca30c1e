"""Core truncation: magnitude threshold (B9) and top-k by magnitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import above
from ..session import VALUE
from ..tensor import modes_of

# Largest k for which the ordered limit is used: its merge gets k rows from each task.
_DIRECT_K = 1_000
# Most tasks of that merge.
_DIRECT_TASKS = 4_000
# Bits of one selection round; a round looks at 2^bits counts at most.
_DIGIT = 16
# The cells written before the last rounds are at most one in so many, or 4 k (but for cells that stand more than once).
_SHARE = 64


def sparsify(t: DataFrame, precision: float, value: str = VALUE) -> DataFrame:
    """Keep cells with ``abs(value) > precision`` (strict, S7)."""
    return t.filter(above(value, precision))


def magnitude_bits(value: str = VALUE) -> Column:
    """The IEEE bits of ``abs(value)`` as a long: ordered like the magnitudes (NaN above infinity).

    Exact: the exponent comes from ``log2`` and is corrected by comparison, and scaling
    by powers of two loses no bit.
    """
    v = F.abs(F.col(value).cast("double"))
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.greatest(F.floor(F.log2(v)), F.lit(-1022))
    e = F.when(two(guess) > v, guess - 1).when(two(guess + 1) <= v, guess + 1).otherwise(guess)
    e = F.greatest(e, F.lit(-1022)).cast("double")
    mantissa = v * two(-e) - 1
    normal = (e.cast("long") + 1023) * (1 << 52) + (mantissa * float(1 << 52)).cast("long")
    return (F.when(F.isnan(v), F.lit(2047 << 52) + 1).when(v > 1.7976931348623157e308, F.lit(2047 << 52))
            .when(v < 2.2250738585072014e-308, (v * float(1 << 537) * float(1 << 537)).cast("long")).otherwise(normal))


def _steps(x: Column, lo, hi) -> Column:
    """A long below 2^16 that does not fall as the number ``x`` grows from ``lo`` to ``hi`` and is not the same for the two."""
    if isinstance(lo, int) and hi - lo < 1 << _DIGIT:
        return x.cast("long") - F.lit(lo)
    return F.floor((x.cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) * float((1 << _DIGIT) - 1))


def _magnitude_steps(x: Column) -> Column:
    """The first digit of a magnitude: 512 steps to each factor of e up to e^40 and down to e^-40, 8 beyond; below 2^16 in all.

    Zero, infinity and NaN stand apart.
    """
    low, high = 4.248354255291589e-18, 2.3538526683702e17           # e^-40, e^40
    return (F.when(F.isnan(x), F.lit(40_000)).when(x > 1.7976931348623157e308, F.lit(39_999)).when(x == 0, F.lit(-40_000))
            .when(x < low, F.floor(F.log(x) * 8) - 21_000).when(x > high, F.floor(F.log(x) * 8) + 21_000)
            .otherwise(F.floor(F.log(x) * 512)))


class _Selection:
    """Finds the rows that come before the ``k``-th and those that tie with it, key by key.

    Each round reads ``t`` once, counts the rows that are still undecided per digit of
    the key (at most 2^16 counts come back, each with the digit's least and largest key)
    and goes on with the rows between these two keys of the digit where the k-th row is.
    No rows are sorted, moved or written.  It ends when a round leaves at most ``slack``
    rows more than k, or one in ``share`` of all rows.
    """

    def __init__(self, t: DataFrame, k: int, slack: int = 0, share: int | None = None, weight: Column | None = None):
        self.t, self.k, self.slack, self.share = t, k, slack, share
        self.n = F.count(F.lit(1)) if weight is None else F.sum(weight)
        self.sure, self.ties = F.lit(False), F.lit(True)        # rows before the k-th; undecided rows, the k-th among them
        self.before, self.here, self.total = 0, None, None      # how many these are

    def rows(self) -> int:
        return self.before + self.here

    def kept(self) -> DataFrame:
        return self.t.where(self.sure | self.ties)

    def done(self) -> bool:
        return self.here is not None and self.rows() <= max(self.k + self.slack, self.total // self.share if self.share else 0)

    def by_number(self, x: Column, digit, largest: bool = False, following: Column | None = None) -> tuple | None:
        """Narrow by the number ``x``, ``digit`` giving the first round's digits; the span of ``following`` among the ties."""
        sure, outer = self.sure, self.ties
        counts = [self.n.alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi")]
        if following is not None:
            counts += [F.min(following).alias("__flo"), F.max(following).alias("__fhi")]
        while True:
            found = self.t.where(self.ties).groupBy(digit(x).alias("__d")).agg(*counts).collect()
            self.total = sum(g["__n"] for g in found) if self.total is None else self.total
            self.here = 0
            found.sort(key=lambda g: (g["__d"] is None, 0 if g["__d"] is None else -g["__d"] if largest else g["__d"]))
            for g in found:
                self.before, self.here = self.before + self.here, g["__n"]
                if self.rows() >= self.k:
                    break
            if not found:
                return None
            lo, hi = g["__lo"], g["__hi"]
            if lo is None:                                      # nulls come last
                self.sure, self.ties = sure | (outer & x.isNotNull()), outer & x.isNull()
            else:
                self.sure = sure | (outer & (x > F.lit(hi) if largest else x < F.lit(lo)))
                self.ties = outer & (x >= F.lit(lo)) & (x <= F.lit(hi))
            if lo is None or lo == hi or lo != lo or self.done():
                return (g["__flo"], g["__fhi"]) if following is not None else None
            digit = lambda c, lo=lo, hi=hi: _steps(c, lo, hi)

    def by_label(self, mode: str) -> None:
        """Narrow by a mode that is no integer: its labels are counted and ranked, the ranks searched."""
        from ..sources.build import dense_index
        counts = self.t.where(self.ties).groupBy(F.col(mode).alias("__label")).agg(self.n.alias("__n")).checkpoint(eager=True)
        ranks = dense_index(counts, "__label", "__rank", "long").withColumnRenamed("__label", "__ranked")
        ranked = counts.join(ranks, F.col("__label").eqNullSafe(F.col("__ranked"))).drop("__ranked").checkpoint(eager=True)
        found = _Selection(ranked, self.k - self.before, weight=F.col("__n"))
        found.by_number(F.col("__rank"), lambda c: _steps(c, 0, max(1, ranked.count() - 1)))
        at = ranked.where(found.ties).orderBy(F.col("__rank").desc()).limit(1).checkpoint(eager=True)      # the last label within
        n = at.first()["__n"]
        self.before, self.here = self.before + found.rows() - n, n
        self.t = self.t.crossJoin(F.broadcast(at.select(F.col("__label").alias(f"__at_{mode}"))))
        col, last = F.col(mode), F.col(f"__at_{mode}")
        self.sure = self.sure | (self.ties & F.coalesce(col < last, col.isNotNull() & last.isNull()))
        self.ties = self.ties & col.eqNullSafe(last)

    def run(self, value: str, modes: list[str]) -> _Selection:
        """Narrow by the magnitudes, largest first, then by the modes."""
        number = {m: F.col(m).cast("long") if isinstance(self.t.schema[m].dataType, T.IntegralType) else None for m in modes}
        following = [number[m] for m in modes] + [None]
        span = self.by_number(F.abs(F.col(value).cast("double")), _magnitude_steps, True, following[0])
        for i, m in enumerate(modes):
            if self.done():
                break
            if number[m] is None:
                self.by_label(m)
                span = None
                continue
            lo, hi = span or self.t.where(self.ties).agg(F.min(number[m]), F.max(number[m])).first()
            if lo is None:                                      # all null
                lo, hi = 0, 0
            span = self.by_number(number[m], lambda c: _steps(c, lo, max(hi, lo + 1)), False, following[i + 1])
        return self


def top_k(t: DataFrame, k: int, value: str = VALUE) -> DataFrame:
    """The ``k`` cells of largest magnitude; ties broken by the coordinates (D5).  Exact for any k and any ties.

    A small ``k`` is an ordered limit: a heap of k rows per task and one merge.  For a
    large ``k``, ``_Selection`` reads ``t`` until it has a bound, by magnitude and, among equal
    magnitudes, by the coordinates, which leaves few rows beyond k; only the cells
    within it are written, and the selection goes on among them to the last cell.  A
    filter gives the result, so no task sorts or receives more than its share, also when all
    magnitudes are equal.  ``t`` itself is never written: it is computed once for each of the
    first rounds, one or two as a rule, and once for the filter.
    """
    modes = modes_of(t, value)
    if k <= _DIRECT_K:
        order = [F.abs(F.col(value)).desc()] + [F.col(m).asc_nulls_last() for m in modes]
        return t.coalesce(_DIRECT_TASKS).orderBy(*order).limit(max(k, 0))
    t = t.where(F.col(value).isNotNull())
    near = _Selection(t, k, 3 * k, _SHARE).run(value, modes)
    kept = near.kept().select(*t.columns).checkpoint(eager=True)
    n = kept.count()
    if n < min(k, near.total):         # t came out otherwise when computed again: take it as it is now
        kept = t.checkpoint(eager=True)
        n = kept.count()
    if n <= k:
        return kept
    last = _Selection(kept, k).run(value, modes)
    if last.rows() == k:
        return last.kept().select(*t.columns)
    cells = last.t.where(last.ties).select(*t.columns).orderBy(value).limit(k - last.before)      # cells that stand more than once
    return last.t.where(last.sure).select(*t.columns).unionByName(cells)
