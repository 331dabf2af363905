"""Numeric predicates and expressions shared by the batch and streaming jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def price_delta(old: str | Column, new: str | Column) -> Column:
    """Relative change ``|old / new - 1|``, measured against the new price.

    A new price of zero gives infinity, or NaN when the old one is zero too.
    """
    old, new = _col(old).cast("double"), _col(new).cast("double")
    by_zero = F.when(old == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return F.when(new == 0, by_zero).otherwise(F.abs(F.try_divide(old, new) - 1))


def price_changed(old: str | Column, new: str | Column, threshold: float = 0.05) -> Column:
    """True where the price moved by more than ``threshold``."""
    delta = price_delta(old, new)
    return ~F.isnan(delta) & (delta > threshold)


def int_mean(total: str, n: str) -> Column:
    """Integer mean of a sum column and a count column, truncating toward zero."""
    return F.expr(f"`{total}` div `{n}`")


def guarded_correlation(x: str | Column, y: str | Column) -> Column:
    """Population correlation; NaN when either side is constant."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(sd > 0, F.covar_pop(x, y) / sd).otherwise(F.lit(float("nan")))


def log_normal_steps(uniform: str | Column, max_steps: int, cap: Column | None = None) -> Column:
    """Whole number of steps a row is late, from a uniform value in [0, 1).

    The number follows a standard log-normal variate rounded to the next
    integer, minus one and not below zero, conditioned on at most ``max_steps``
    (and at most ``cap`` per row, where given). Inverting the conditioned
    distribution keeps every row, so no resampling is needed.
    """
    u = _col(uniform)
    cdf = [0.5 * (1 + math.erf(math.log(k + 1.5) / math.sqrt(2))) for k in range(max_steps + 1)]
    table = F.array(*[F.lit(p) for p in cdf])
    limit = F.lit(max_steps) if cap is None else F.greatest(F.lit(0), F.least(cap, F.lit(max_steps)))
    target = u * F.element_at(table, (limit + 1).cast("int"))
    steps = F.lit(0)
    for p in cdf[:-1]:
        steps = steps + (target >= F.lit(p)).cast("int")
    return steps


def hash_uniform(*cols: str | Column, seed: int = 100) -> Column:
    """Uniform value in [0, 1) that depends only on the given columns."""
    bits = F.xxhash64(*[_col(c) for c in cols], F.lit(seed))
    return F.pmod(bits, F.lit(1 << 52)).cast("double") / float(1 << 52)


def next_power_of_two(n: str | Column) -> Column:
    """Smallest power of two that is not below ``n`` (``n`` at least 1)."""
    n = _col(n).cast("long")
    # bin(n - 1) has as many digits as the exponent; n = 1 is the exception.
    return F.when(n <= 1, F.lit(1)).otherwise(
        F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("long")
    ).cast("long")
