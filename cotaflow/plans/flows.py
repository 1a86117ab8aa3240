"""Money coming in and going out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotaflow.functions.missing import skip_sum, strict_sum, zero_sum
from cotaflow.functions.periods import month_start, quarter_label, quarter_start
from cotaflow.operators.reshape import row_total, wide
from cotaflow.operators.totals import totals_by_lookup
from cotaflow.operators.windows import running_sum, trailing_sum
from cotaflow.plans.base import within_quarters, within_years

BILLION = 1e9
Rule = Callable[[Column], Column]


def quarterly_totals(
    daily: DataFrame,
    classes: DataFrame,
    by: list[str],
    first: tuple[int, int],
    last: tuple[int, int],
    weights: DataFrame | None = None,
    rule: Rule = strict_sum,
    scale: float = BILLION,
    labelled: bool = False,
) -> DataFrame:
    """``inflow``, ``outflow`` (negative) and ``net`` per quarter and class columns.

    The period is the first day of the quarter or, ``labelled``, a text such as ``2010 T1``.
    """
    sums = totals_by_lookup(
        within_quarters(daily, first, last),
        classes,
        {"quarter": quarter_start(F.col("dt"))},
        {"inflow": F.col("inflow"), "outflow": F.col("outflow")},
        by,
        rule,
        weights,
    )
    if labelled:
        sums = sums.withColumn("quarter", quarter_label(F.col("quarter")))
    return sums.withColumns({"inflow": F.col("inflow") / scale, "outflow": -F.col("outflow") / scale}).withColumn(
        "net", F.col("inflow") + F.col("outflow")
    )


def quarterly_flow(
    daily: DataFrame,
    classes: DataFrame,
    first: tuple[int, int],
    last: tuple[int, int],
    weights: DataFrame | None = None,
    scale: float = BILLION,
) -> DataFrame:
    """Quarterly inflow, outflow, net flow and the running net flow of the classes given."""
    totals = quarterly_totals(daily, classes, [], first, last, weights, strict_sum, scale)
    order = [F.asc_nulls_last("quarter")]
    return totals.withColumn("net_cum", running_sum("net", order)).orderBy(*order)


def quarterly_net_by_category(
    daily: DataFrame, classes: DataFrame, first: tuple[int, int], last: tuple[int, int], columns: dict[str, object]
) -> DataFrame:
    """Quarterly net flow with one column per category; no row, no value."""
    totals = quarterly_totals(daily, classes, ["category"], first, last)
    return wide(totals, ["quarter"], "category", "net", columns)


def quarterly_flow_by_type(
    daily: DataFrame,
    classes: DataFrame,
    first: tuple[int, int],
    last: tuple[int, int],
    weights: DataFrame | None = None,
    rule: Rule = skip_sum,
    scale: float = BILLION,
    labelled: bool = True,
) -> DataFrame:
    """Quarterly flows per type.  Sums in the database skip missing values; local ones do not."""
    return quarterly_totals(daily, classes, ["type"], first, last, weights, rule, scale, labelled)


def _net() -> Column:
    return F.col("inflow") - F.col("outflow")


def annual_net(daily: DataFrame, classes: DataFrame, first: int, last: int, scale: float = BILLION) -> DataFrame:
    """Net flow per year and type."""
    rows = within_years(daily, first, last)
    sums = totals_by_lookup(rows, classes, {"year": F.year("dt")}, {"net": _net()}, ["type"], zero_sum)
    return sums.withColumn("net", F.col("net") / scale)


def annual_net_by_type_wide(
    daily: DataFrame, classes: DataFrame, types: dict[str, str], first: int, last: int, scale: float = BILLION
) -> DataFrame:
    """Net flow per year with one column per type and their total."""
    table = wide(annual_net(daily, classes, first, last, scale), ["year"], "type", "net", types, fill=0.0, total="total")
    return table.withColumn("year", F.col("year").cast("string"))


def annual_net_by_year_wide(
    daily: DataFrame, classes: DataFrame, first: int, last: int, scale: float = BILLION
) -> DataFrame:
    """Net flow per type with one column per year and the row total at the end."""
    years = {str(y): y for y in range(first, last + 1)}
    table = wide(annual_net(daily, classes, first, last, scale), ["type"], "year", "net", years, fill=0.0)
    return table.select("type", *years, row_total(list(years)).alias("total"))


def monthly_flow(daily: DataFrame, classes: DataFrame, first: int, last: int, scale: float = BILLION) -> DataFrame:
    """Gross inflow, outflow (negative) and net flow per month."""
    d = F.col("dt")
    sums = totals_by_lookup(
        within_years(daily, first, last),
        classes,
        {"year": F.year(d), "month": F.month(d)},
        {"inflow": F.col("inflow"), "outflow": F.col("outflow")},
        [],
        zero_sum,
    )
    return sums.select(
        month_start(F.col("year"), F.col("month")).alias("month"),
        (F.col("inflow") / scale).alias("inflow"),
        (-F.col("outflow") / scale).alias("outflow"),
        (F.col("inflow") / scale - F.col("outflow") / scale).alias("net"),
    )


def monthly_net_by_type(
    daily: DataFrame, classes: DataFrame, first: int, last: int, scale: float = BILLION
) -> DataFrame:
    """Net flow per month and type."""
    d = F.col("dt")
    sums = totals_by_lookup(
        within_years(daily, first, last),
        classes,
        {"year": F.year(d), "month": F.month(d)},
        {"net": _net()},
        ["type"],
        zero_sum,
    )
    return sums.select(
        month_start(F.col("year"), F.col("month")).alias("month"), "type", (F.col("net") / scale).alias("net")
    )


def rolling_flow(monthly: DataFrame, months: int = 12) -> DataFrame:
    """Net flow of the last ``months`` rows of each type, where there are that many."""
    rolled = trailing_sum("net", months, [F.asc_nulls_last("month")], ["type"])
    return monthly.withColumn("net_rolling", rolled).where(F.col("net_rolling").isNotNull())


def cumulative_flow(monthly: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Running net flow, over everything or per group."""
    return monthly.withColumn("net_cum", running_sum("net", [F.asc_nulls_last("month")], by))
