"""How many different funds reported in any period, from bitmaps that are kept by month.

Funds get dense numbers once.  A month's funds of a type are then bits, 32 768 to a bitmap, and the funds of a period are
the bits set in any of its months: bitmaps are merged by OR and counted, and the daily rows are not read again.
A type with a third of all funds has as many more bitmaps; none of them is larger than 4 KB.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.operators.joins import lookup_join
from cotaflow.operators.prefix import numbered
from cotaflow.sources.scratch import staged


def fund_numbers(daily: DataFrame) -> DataFrame:
    """(fund, number) of every fund; a missing id is no fund."""
    return numbered(daily.where(F.col("fund").isNotNull()).select("fund").distinct(), ["fund"], "number")


def month_bitmaps(daily: DataFrame, types: DataFrame, numbers: DataFrame) -> DataFrame:
    """(dt, type, bucket, bits): the funds of each type that reported in each month, staged.

    ``types`` has (fund, type); a fund of several types counts for each, one without for a missing type.  Rows without
    a day or a fund are left out.  Daily rows are first reduced to fund-months.
    """
    months = daily.where(F.col("dt").isNotNull()).select("fund", F.trunc("dt", "MM").cast("date").alias("dt")).distinct()
    typed = lookup_join(lookup_join(months, numbers, "fund", "inner"), types.select("fund", "type").distinct(), "fund")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    return staged(typed.groupBy("dt", "type", F.bitmap_bucket_number("number").alias("bucket")).agg(bits), "month-bitmaps")


def active_funds(bitmaps: DataFrame, first: dt.date, last: dt.date, by_type: bool = True) -> DataFrame:
    """Number of different funds in the months from that of ``first`` to that of ``last``, per type or in all."""
    by = ["type"] if by_type else []
    months = bitmaps.where(F.col("dt").between(F.lit(first.replace(day=1)), F.lit(last)))
    merged = months.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def active_by_year(bitmaps: DataFrame) -> DataFrame:
    """Number of different funds per type and year."""
    merged = bitmaps.groupBy("type", F.year("dt").alias("year"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("type", "year").agg(F.sum(F.bitmap_count("bits")).alias("n"))
