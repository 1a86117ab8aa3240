"""Daily rows summed once per fund and month, and once per fund and year, to feed many reports.

Every sum of ``functions.missing`` can be applied again to its own partial results, so the reports that take
daily rows give the same from these tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.functions.measures import growth_pct
from cotaflow.functions.missing import skip_sum, zero_sum
from cotaflow.operators.ordered import first_value, last_value
from cotaflow.plans.base import within_years

MEASURES = ("inflow", "outflow", "balance")
BILLION = 1e9


def total_order(rows: DataFrame, order_by: list[str], key: str = "fund") -> list[str]:
    """``order_by`` and then all other columns, so that no two different rows tie."""
    return [*order_by, *sorted(c for c in rows.columns if c != key and c not in order_by)]


def fund_months(daily: DataFrame) -> DataFrame:
    """Per fund and month (``dt``, its first day): rows, sums and numbers of values; undated rows have no month."""
    sums = [skip_sum(F.col(m)).alias(m) for m in MEASURES] + [F.count(m).alias(f"n_{m}") for m in MEASURES]
    net = skip_sum(F.col("inflow") - F.col("outflow")).alias("net")
    month = F.trunc("dt", "MM").cast("date").alias("dt")
    return daily.groupBy("fund", month).agg(F.count(F.lit(1)).alias("rows"), *sums, net)


def strict(months: DataFrame) -> DataFrame:
    """Months as daily rows for strict sums: missing where any value was."""
    return months.select("fund", "dt", *[F.when(F.col(f"n_{m}") == F.col("rows"), F.col(m)).alias(m) for m in MEASURES])


def skipping(months: DataFrame) -> DataFrame:
    """Months as daily rows for sums that skip missing values."""
    return months.select("fund", "dt", *MEASURES)


def netted(months: DataFrame) -> DataFrame:
    """Months as daily rows for net flows, which count days with both flows."""
    return months.select("fund", "dt", F.col("net").alias("inflow"), F.lit(0.0).alias("outflow"))


def fund_years(daily: DataFrame, first: int, last: int, order_by: list[str], skip_missing: bool = False) -> DataFrame:
    """Per fund and year: first and last quota, closing balance, last day and net flow, in one pass."""
    return (
        within_years(daily, first, last)
        .groupBy("fund", F.year("dt").alias("year"))
        .agg(
            first_value("quota", order_by, skip_missing).alias("start"),
            last_value("quota", order_by, skip_missing).alias("end"),
            last_value("balance", order_by).alias("balance"),
            F.max("dt").alias("dt"),
            zero_sum(F.col("inflow") - F.col("outflow")).alias("net"),
        )
    )


def returns_of(years: DataFrame, zero: str = "ieee") -> DataFrame:
    """``returns.annual_return`` from ``fund_years``."""
    return years.select("fund", "year", growth_pct(F.col("start"), F.col("end"), zero).alias("ret"))


def closing_of(years: DataFrame, scale: float = BILLION) -> DataFrame:
    """``balances.fund_years`` from ``fund_years``."""
    return years.select("fund", "year", (F.col("balance") / scale).alias("balance"), "dt", (F.col("net") / scale).alias("net"))
