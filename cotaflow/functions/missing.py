"""Aggregates that spell out what happens to missing values.

Three sums are needed because the studies use three: one that becomes missing as soon as any addend
is missing, one that skips missing addends, and one that skips them and yields zero for an empty sum.
Each of them can be applied again to its own partial results, so a total may be built in two steps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_sum(x: Column) -> Column:
    """Sum that is NULL when any addend is NULL."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def skip_sum(x: Column) -> Column:
    """Sum over the non-NULL addends; NULL when there is none."""
    return F.sum(x)


def zero_sum(x: Column) -> Column:
    """Sum over the non-NULL addends; 0 when there is none."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def strict_compound(rate_pct: Column) -> Column:
    """Compounded rate in percent, NULL when any rate is NULL."""
    return F.when(F.count(rate_pct) == F.count(F.lit(1)), compound(rate_pct))


def compound(rate_pct: Column) -> Column:
    """Compounded rate in percent over the non-NULL rates; 0 when there is none."""
    return (F.coalesce(F.product(1 + rate_pct / 100), F.lit(1.0)) - 1) * 100


def present(x: Column) -> Column:
    """Neither NULL nor NaN."""
    return x.isNotNull() & ~F.isnan(x)


def finite(x: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return present(x) & (F.abs(x) < F.lit(float("inf")))


def not_in(x: Column, values: list) -> Column:
    """``x`` is not one of ``values``; a NULL ``x`` passes."""
    return ~F.coalesce(x.isin(values), F.lit(False))
