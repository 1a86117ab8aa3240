"""Which funds and rows a study looks at."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotaflow.functions.labels import REST
from cotaflow.functions.periods import in_quarters, in_years
from cotaflow.operators.joins import keep_members, lookup_join
from cotaflow.operators.ordered import latest_row
from cotaflow.sources.scratch import staged

# Funds the studies leave out because the source repeats them.
REPEATED_FUND = "58137699000116"
LEFT_OUT_FUNDS = ["60711810000188", "52590576000150", "52661025000130", "52746800000150", "58823409000198"]


def study_classes(classes: DataFrame, category: str, repeated: str = REPEATED_FUND) -> DataFrame:
    """Classification of one category without the repeated fund."""
    return classes.where((F.col("fund") != repeated) & (F.col("category") == category))


def open_class_rows(
    classes: DataFrame, category: str, left_out: list[str] = LEFT_OUT_FUNDS, structure: str = "Classe"
) -> DataFrame:
    """Classification of one category for the flow study: classes only, with a named type.

    A missing id goes too, as it would in a database.
    """
    return classes.where(
        (F.col("category") == category)
        & ~F.col("fund").isin(left_out)
        & F.col("type").isNotNull()
        & (F.col("type") != REST)
        & (F.col("structure") == structure)
    )


def classified_daily(daily: DataFrame, classes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Daily rows of the classified funds with the class columns attached."""
    attributes = classes if columns is None else classes.select("fund", *columns)
    return lookup_join(daily, attributes, "fund", "inner")


def with_latest_snapshot(daily: DataFrame, snapshots: DataFrame, columns: list[str], ties: list[str]) -> DataFrame:
    """Daily rows with the given columns of the fund's latest snapshot, one row for each.

    The latest snapshots are staged: a join whose side comes straight out of an aggregation is one
    the adaptive planner does not split for a hot fund.
    """
    latest = snapshots.groupBy("fund").agg(latest_row(columns, "dt", ties, False).alias("row"))
    return lookup_join(daily, staged(latest.select("fund", "row.*"), "latest"), "fund")


# Partition columns of the consolidated daily table.
YEAR_PARTITION, MONTH_PARTITION = "dt_year", "dt_month"


def within_years(daily: DataFrame, first: int, last: int) -> DataFrame:
    """Daily rows of the years ``first`` to ``last``.

    The consolidated table is partitioned by the year of ``dt``; where that column is there, it is filtered
    as well, so that other years' files are never opened.
    """
    return _year_partitions(daily, first, last).where(in_years(F.col("dt"), first, last))


def within_quarters(daily: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Daily rows of the quarters ``(year, quarter)`` from ``first`` to ``last``."""
    return _year_partitions(daily, first[0], last[0]).where(in_quarters(F.col("dt"), first, last))


def _year_partitions(daily: DataFrame, first: int, last: int) -> DataFrame:
    return daily.where(F.col(YEAR_PARTITION).between(first, last)) if YEAR_PARTITION in daily.columns else daily


def for_funds(daily: DataFrame, chosen: DataFrame, summarise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``summarise(daily)``, a table with few rows per fund, for the chosen funds.

    Funds are matched after the rows of each are summed, so the daily rows are never shuffled to meet
    the list, however long it is.  Rows of other funds mostly go before they are summed: the planner joins a list
    that it broadcasts below the sums, and makes a Bloom filter at the scan of a longer one, provided it sees
    how the list was selected (its scan and conditions; a list that comes from a staged table has none) and
    ``session.tune`` has set the sizes from which on that pays.
    """
    return keep_members(summarise(daily), chosen.select("fund"), "fund")


def snapshot_weights(snapshots: DataFrame, wanted: Column | None = None) -> DataFrame:
    """``fund`` and ``weight``, the number of its snapshots (of those that are ``wanted``).

    The studies join every snapshot of a fund to every day and sum afterwards.  Each day then counts
    once per snapshot, which the weight states without building the repeated rows.
    """
    rows = snapshots if wanted is None else snapshots.where(wanted)
    return rows.groupBy("fund").agg(F.count(F.lit(1)).alias("weight"))


def with_policy(snapshots: DataFrame) -> DataFrame:
    """Weights of the funds that have a snapshot with a stated policy."""
    return snapshot_weights(snapshots, F.col("policy").isNotNull())


def once_per_fund(weights: DataFrame) -> DataFrame:
    """The same funds, each counted once: the corrected reading of the snapshot join."""
    return weights.withColumn("weight", F.lit(1).cast("bigint"))
