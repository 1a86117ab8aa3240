"""Calendar expressions.  Period filters are plain date ranges so that scans can prune on them."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_start(d: Column) -> Column:
    """First day of the quarter."""
    return F.trunc(d, "QUARTER").cast("date")


def month_start(year: Column, month: Column) -> Column:
    """Date of the first day of a month given as numbers."""
    return F.make_date(year, month, F.lit(1))


def quarter_label(d: Column) -> Column:
    """Text such as ``2010 T1``; its alphabetical order is its time order."""
    return F.concat(F.date_format(d, "yyyy"), F.lit(" T"), F.quarter(d).cast("string"))


def quarter_label_of(year: int, quarter: int) -> str:
    return f"{year} T{quarter}"


def in_years(d: Column, first: int, last: int) -> Column:
    """``d`` lies in the years ``first`` to ``last``, both included."""
    return (d >= F.lit(dt.date(first, 1, 1))) & (d < F.lit(dt.date(last + 1, 1, 1)))


def in_quarters(d: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """``d`` lies in the quarters ``(year, quarter)`` from ``first`` to ``last``, both included."""
    start = dt.date(first[0], 3 * first[1] - 2, 1)
    following = (last[0] + 1, 1) if last[1] == 4 else (last[0], last[1] + 1)
    stop = dt.date(following[0], 3 * following[1] - 2, 1)
    return (d >= F.lit(start)) & (d < F.lit(stop))


def dated_sequence(d: Column, sequence: Column) -> Column:
    """Day and sequence number as one number that sorts by day, then by number; a missing one comes first.

    First and last values ordered by a single number are found by hash aggregation, without sorting the
    rows by group as a day and a number side by side need.  Any day and any long fit.
    """
    day = F.coalesce(F.unix_date(d).cast("bigint"), F.lit(-(1 << 32))).cast("decimal(10,0)")
    number = F.coalesce(sequence.cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)))
    return day * F.lit(Decimal(1 << 65)) + number


def number_from_text(x: Column) -> Column:
    """Whole number held in a text, NULL when it is not one."""
    return x.try_cast("int")
