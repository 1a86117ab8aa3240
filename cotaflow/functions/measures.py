"""Return measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def growth_pct(first: Column, last: Column, zero: str = "ieee") -> Column:
    """``(last / first - 1) * 100``.

    With ``zero="ieee"`` a zero ``first`` gives an infinity or NaN, which the outlier and finiteness
    rules then see; with ``zero="null"`` it gives NULL.
    """
    ratio = F.try_divide(last, first)
    if zero == "ieee":
        by_zero = (
            F.when(F.isnan(last) | (last == 0), F.lit(float("nan")))
            .when(last > 0, F.lit(float("inf")))
            .when(last < 0, F.lit(float("-inf")))
        )
        ratio = F.when(first == 0, by_zero).otherwise(ratio)
    elif zero != "null":
        raise ValueError(f"zero must be 'ieee' or 'null', not {zero!r}")
    return (ratio - 1) * 100


def beyond(x: Column, limit: float) -> Column:
    """``x`` is above ``limit`` or below ``-limit``; NULL and NaN are neither."""
    return F.coalesce(~F.isnan(x) & ((x > limit) | (x < -limit)), F.lit(False))
