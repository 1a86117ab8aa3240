"""What the funds hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.functions.missing import skip_sum, zero_sum
from cotaflow.functions.periods import quarter_label, quarter_start
from cotaflow.operators.joins import lookup_join
from cotaflow.operators.ordered import last_value
from cotaflow.operators.reshape import wide
from cotaflow.operators.totals import totals_by_lookup
from cotaflow.operators.windows import step_change
from cotaflow.plans.base import within_quarters, within_years

BILLION = 1e9


def custody_sum(
    daily: DataFrame,
    classes: DataFrame,
    first: tuple[int, int],
    last: tuple[int, int],
    weights: DataFrame | None = None,
    rule=skip_sum,
    scale: float = BILLION,
    labelled: bool = True,
) -> DataFrame:
    """Daily balances added up per quarter and type, as the studies chart them.

    It adds a stock over the days of the quarter; ``year_end_balance`` is the balance itself.
    """
    sums = totals_by_lookup(
        within_quarters(daily, first, last),
        classes,
        {"quarter": quarter_start(F.col("dt"))},
        {"custody": F.col("balance")},
        ["type"],
        rule,
        weights,
    )
    if labelled:
        sums = sums.withColumn("quarter", quarter_label(F.col("quarter")))
    return sums.withColumn("custody", F.col("custody") / scale)


def fund_years(daily: DataFrame, first: int, last: int, order_by: list[str], scale: float = BILLION) -> DataFrame:
    """Per fund and year: closing balance, its date, and net flow, from one pass over the daily rows."""
    return (
        within_years(daily, first, last)
        .groupBy("fund", F.year("dt").alias("year"))
        .agg(
            (last_value("balance", order_by) / scale).alias("balance"),
            F.max("dt").alias("dt"),
            (zero_sum(F.col("inflow") - F.col("outflow")) / scale).alias("net"),
        )
    )


def year_end_balance(closing: DataFrame, classes: DataFrame) -> DataFrame:
    """Closing balances per year and type, from ``fund_years``; repeated class rows count once."""
    typed = lookup_join(closing, classes.select("fund", "type").distinct(), "fund", "inner")
    return typed.groupBy("year", "type").agg(
        zero_sum(F.col("balance")).alias("balance"), F.max("dt").alias("dt")
    )


def year_end_balance_wide(closing: DataFrame, classes: DataFrame, types: dict[str, str]) -> DataFrame:
    """Closing balances with one column per type and their total.

    Types close on different dates, and the date stays part of the row's identity, as in the studies.
    """
    table = wide(year_end_balance(closing, classes), ["year", "dt"], "type", "balance", types, fill=0.0, total="total")
    return table.withColumn("year", F.col("year").cast("string"))


def reconciliation(closing: DataFrame, classes: DataFrame) -> DataFrame:
    """Yearly change of the total balance, split into net flow and the return it implies.

    A balance counts once for each type of its fund, as in ``year_end_balance``; flows count once for each
    class row, as in the flow reports.
    """
    per_fund = classes.groupBy("fund").agg(
        F.count(F.lit(1)).alias("class_rows"), F.size(F.collect_set(F.coalesce("type", F.lit("")))).alias("types")
    )
    kept = lookup_join(closing, per_fund, "fund", "inner")
    yearly = kept.groupBy("year").agg(
        F.max("dt").alias("dt"),
        zero_sum(F.col("balance") * F.col("types")).alias("balance"),
        zero_sum(F.col("net") * F.col("class_rows")).alias("net"),
    )
    return (
        yearly.withColumn("change", step_change("balance", [F.asc_nulls_last("year")]))
        .withColumn("implied_return", F.col("change") - F.col("net"))
        .where(F.col("change").isNotNull())
        .withColumn("year", F.col("year").cast("string"))
    )
