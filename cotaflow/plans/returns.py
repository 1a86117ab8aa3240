"""Annual returns of funds and benchmarks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotaflow.functions.measures import beyond, growth_pct
from cotaflow.functions.missing import compound, finite, strict_compound
from cotaflow.functions.text import short_name
from cotaflow.operators.distribution import within_fences
from cotaflow.operators.joins import calendar_join, keep_members, lookup_join
from cotaflow.operators.ordered import first_value, last_value
from cotaflow.operators.ranking import largest_groups
from cotaflow.operators.windows import running_compound
from cotaflow.plans.base import within_years


def annual_return(
    daily: DataFrame, first: int, last: int, order_by: list[str], skip_missing: bool = False, zero: str = "ieee"
) -> DataFrame:
    """Return in percent per fund and year, from the first and last quota of the year.

    ``order_by`` starts with the date; more columns decide between rows of one day.  ``skip_missing``
    takes the first and last quota that are present; otherwise a missing one makes the return missing.
    """
    start, end = (f("quota", order_by, skip_missing) for f in (first_value, last_value))
    return (
        within_years(daily, first, last)
        .groupBy("fund", F.year("dt").alias("year"))
        .agg(start.alias("start"), end.alias("end"))
        .select("fund", "year", growth_pct(F.col("start"), F.col("end"), zero).alias("ret"))
    )


def plausible(returns: DataFrame, above: float = -100, below: float = 300) -> DataFrame:
    """Finite returns strictly between the bounds."""
    r = F.col("ret")
    return returns.where(finite(r) & (r > above) & (r < below))


def rate_by_year(rates: DataFrame, first: int, last: int, strict: bool = False) -> DataFrame:
    """Monthly rates compounded per year.  ``strict`` makes a year with a missing month missing."""
    rule = strict_compound if strict else compound
    return (
        within_years(rates, first, last)
        .groupBy(F.year("dt").alias("year"))
        .agg(rule(F.col("rate_pct")).alias("benchmark"))
    )


def rate_running(rates: DataFrame) -> DataFrame:
    """Rate compounded since the start of the year, month by month."""
    yearly = rates.withColumn("year", F.year("dt"))
    return yearly.withColumn("running", running_compound("rate_pct", [F.asc_nulls_last("dt")], ["year"]))


def index_by_year(closes: DataFrame, first: int, last: int, leave_out: dt.date | None = None) -> DataFrame:
    """Return of an index per year from its first and last close, without one bad date."""
    rows = within_years(closes, first, last)
    if leave_out is not None:
        rows = rows.where(F.col("dt") != F.lit(leave_out))
    return (
        rows.groupBy(F.year("dt").alias("year"))
        .agg(first_value("close", ["dt"]).alias("start"), last_value("close", ["dt"]).alias("end"))
        .select("year", growth_pct(F.col("start"), F.col("end")).alias("benchmark"))
    )


def with_type_and_benchmark(returns: DataFrame, classes: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Fund-years with the fund's type and the year's benchmark."""
    types = classes.select("fund", "type").distinct()
    return calendar_join(lookup_join(returns, types, "fund", "left", nulls_match=True), benchmark)


def outlier_funds(returns: DataFrame, limit: float) -> DataFrame:
    """Funds with any return beyond the limit."""
    return returns.where(beyond(F.col("ret"), limit)).select("fund").distinct()


def mark_outlier_funds(returns: DataFrame, limit: float) -> DataFrame:
    """``is_out``: the fund has a return beyond the limit in any year.

    One pass over fund-years, which are at most one row per year for a fund, so no fund is large here.
    """
    return returns.withColumn("is_out", F.max(beyond(F.col("ret"), limit)).over(Window.partitionBy("fund")))


def without_outlier_funds(returns: DataFrame, limit: float) -> DataFrame:
    """Leave out every year of a fund that has a return beyond the limit in any year."""
    return mark_outlier_funds(returns, limit).where(~F.col("is_out")).drop("is_out")


def funds_by_type(returns: DataFrame) -> DataFrame:
    """Number of funds per type among fund-years, largest first."""
    counts = returns.select("fund", "type").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc_nulls_last("n"), F.asc_nulls_last("type"))


def main_types(returns: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` types with most funds."""
    return largest_groups(funds_by_type(returns), "type", "n", k)


def trimmed_returns(returns: DataFrame, k: int = 5, prefix: str = "Multimercados", method: str = "radix") -> DataFrame:
    """Returns of the main types inside their type's and year's fences, with a short type name."""
    main = keep_members(returns, main_types(returns, k), "type", nulls_match=True)
    inside = within_fences(main, ["type", "year"], "ret", method)
    return inside.withColumn("type_short", short_name(F.col("type"), prefix))

