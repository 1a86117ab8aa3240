"""Period spines that name the files of each vintage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_spine(bounds: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """``month`` and its ``yyyymm`` text for every month between two dates of a one-row table."""
    start, stop = F.trunc(first, "MM").cast("date"), F.trunc(last, "MM").cast("date")
    months = bounds.select(F.explode(F.sequence(start, stop, F.expr("interval 1 month"))).alias("month"))
    return months.select("month", F.date_format("month", "yyyyMM").alias("yyyymm"))


def yearly_spine(bounds: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """``year`` for every year between two dates of a one-row table."""
    return bounds.select(F.explode(F.sequence(F.year(first), F.year(last))).alias("year"))
