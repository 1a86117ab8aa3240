"""First, last and latest values by an explicit order.

All are aggregates rather than row-number windows: each task reduces its rows to one per group before
anything is shuffled, so neither a hot group nor a long history has to be sorted in one place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(order_by: list[str]) -> Column:
    """One comparable value for the order.

    A single fixed-width column keeps the aggregation in hash form; several columns are compared as a
    struct, for which every task first sorts its rows by group.
    """
    return F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)


def first_value(value: str, order_by: list[str], skip_missing: bool = False) -> Column:
    return _extreme(F.min_by, value, order_by, skip_missing)


def last_value(value: str, order_by: list[str], skip_missing: bool = False) -> Column:
    return _extreme(F.max_by, value, order_by, skip_missing)


def _extreme(pick, value: str, order_by: list[str], skip_missing: bool) -> Column:
    order = order_key(order_by)
    if skip_missing:
        order = F.when(F.col(value).isNotNull(), order)
    return pick(F.col(value), order)


def latest_row(columns: list[str], date: str, ties: list[str], missing_date_last: bool) -> Column:
    """The given columns of the latest row, as a struct.

    ``missing_date_last`` treats a missing date as later than any date; otherwise it is earlier.
    ``ties`` decides between rows of the same date.
    """
    undated = [F.col(date).isNull()] if missing_date_last else []
    return F.max_by(F.struct(*columns), F.struct(*undated, F.col(date), *ties))
