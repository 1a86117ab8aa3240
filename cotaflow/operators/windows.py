"""Window columns for tables that are already aggregated to a few rows per period or category.

None of them is meant for raw daily rows.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def running_sum(value: str, order_by: list[Column], by: list[str] | None = None) -> Column:
    """Running sum in the given order, row by row (ties are not merged); NULL from the first NULL on."""
    w = _over(order_by, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), F.sum(value).over(w))


def running_compound(rate_pct: str, order_by: list[Column], by: list[str] | None = None) -> Column:
    """Running compounded rate in percent; NULL from the first NULL on."""
    w = _over(order_by, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    factor = F.product(1 + F.col(rate_pct) / 100).over(w)
    return F.when(F.count(rate_pct).over(w) == F.count(F.lit(1)).over(w), (factor - 1) * 100)


def trailing_sum(value: str, rows: int, order_by: list[Column], by: list[str] | None = None) -> Column:
    """Sum of this and the preceding rows, ``rows`` in all; NULL where there are fewer or one is NULL.

    It counts rows, not calendar steps: a missing month stretches the span.
    """
    w = _over(order_by, by).rowsBetween(-(rows - 1), Window.currentRow)
    return F.when(F.count(value).over(w) == rows, F.sum(value).over(w))


def step_change(value: str, order_by: list[Column], by: list[str] | None = None) -> Column:
    """Difference to the previous row."""
    return F.col(value) - F.lag(value).over(_over(order_by, by))


def share_pct(value: str, by: list[str] | None = None) -> Column:
    """Percentage of the total."""
    total = F.sum(value).over(Window.partitionBy(*(by or [])))
    return F.try_divide(F.col(value), total) * 100


def level_code(value: str) -> Column:
    """Rank of the value among the distinct values present, from 1."""
    return F.dense_rank().over(Window.orderBy(F.col(value).asc_nulls_last()))


def _over(order_by: list[Column], by: list[str] | None):
    return Window.partitionBy(*(by or [])).orderBy(*order_by)
