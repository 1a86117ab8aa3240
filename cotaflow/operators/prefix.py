"""Running totals and numbers over ordered tables of any length, by ranges instead of in one task.

Rows are dealt to ranges of the order, each range sorted by one task and written to the shared folder.  Totals of
the ranges, one row for each, give what lies before a range; within it the rest is local.  Sorting, summing and numbering
are so spread over all tasks, and only as many rows as there are ranges meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotaflow.operators.joins import lookup_join
from cotaflow.sources.scratch import staged

_ROWS_OF_RANGE = 33  # bits that Spark's increasing ids leave to the rows of one partition


def _in_ranges(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` sorted over ranges: ``__range`` and the row's place in it, ``__place`` from 0."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    split = placed.withColumns({"__range": F.shiftright("__id", _ROWS_OF_RANGE), "__place": F.col("__id").bitwiseAND(F.lit((1 << _ROWS_OF_RANGE) - 1))})
    return staged(split.drop("__id"), label)


def _with_before(ranges: DataFrame, total: Column) -> DataFrame:
    """``ranges`` with ``__before``, the total of all ranges that come first."""
    totals = ranges.groupBy("__range").agg(total.alias("__total"))
    first = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__total").over(first), F.lit(0))).drop("__total")
    return lookup_join(ranges, totals, "__range")


def running_total(df: DataFrame, value: str, order_by: list[str], name: str) -> DataFrame:
    """``df`` with the total of ``value`` up to and with each row; missing values add nothing.

    ``order_by`` should tell all rows apart, for rows that tie are in any order, and many of them in one range.
    Missing values of the order come first.  For a total per group, or a table of a few thousand rows,
    ``windows.cumulative`` is simpler.
    """
    ranges = _in_ranges(df, [F.asc_nulls_first(c) for c in order_by], "ranges")
    own = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = _with_before(ranges, F.sum(value))
    total = F.col("__before") + F.coalesce(F.sum(value).over(own), F.lit(0))
    return found.withColumn(name, total).select(*df.columns, name)


def numbered(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """``df`` with dense numbers from 1 in the given order, missing values first; staged, so that they stay as they are."""
    found = _with_before(_in_ranges(df, [F.asc_nulls_first(c) for c in order_by], "ranges"), F.count(F.lit(1)))
    return staged(found.select(*df.columns, (F.col("__before") + F.col("__place") + 1).alias(name)), "numbered")


def level_numbers(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the number of its level of ``column`` among the sorted levels, from 1; a missing level has none.

    The same as ``windows.level_code`` where levels are too many for one task.
    """
    levels = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], name)
    return lookup_join(df, levels, column)
