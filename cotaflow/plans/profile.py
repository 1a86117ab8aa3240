"""How many funds there are, and of what kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotaflow.functions.labels import REST, fee_label, feeder_label, lump, mirror_label
from cotaflow.operators.joins import keep_members, lookup_join
from cotaflow.operators.ordered import latest_row
from cotaflow.operators.reshape import wide
from cotaflow.operators.windows import running_sum, share_pct
from cotaflow.plans.base import within_years

FEES = ["entry_fee", "perf_fee", "exit_fee"]


def reporting_funds(daily: DataFrame) -> DataFrame:
    """The distinct funds that report.  Reduced per task, so no join ever sees the daily rows."""
    return daily.select("fund").distinct()


def reporting_funds_of(daily: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen funds that report."""
    return lookup_join(reporting_funds(daily), chosen.select("fund"), "fund", "inner")


def funds_per(daily: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """Number of reporting funds per class attributes.

    The rows are already spread by fund when repeats are removed, so that needs no shuffle of its own.
    """
    known = lookup_join(reporting_funds(daily), classes.select("fund", *by), "fund", "inner").distinct()
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def largest_first(by: list[str], count: str = "n") -> list[Column]:
    return [F.desc_nulls_last(count), *[F.asc_nulls_last(c) for c in by]]


def type_share(daily: DataFrame, classes: DataFrame) -> DataFrame:
    """Funds per category and type, largest first, with share and running share in percent."""
    by = ["category", "type"]
    counts = funds_per(daily, classes, by).withColumn("share", share_pct("n"))
    return counts.withColumn("share_cum", running_sum("share", largest_first(by))).orderBy(*largest_first(by))


def with_total(counts: DataFrame, by: list[str], count: str = "n") -> DataFrame:
    """A table of counts with its footer total as a row of its own, marked by ``is_total``."""
    rows = counts.groupingSets([[F.col(c) for c in by], []], *by)
    return rows.agg((F.grouping_id() > 0).alias("is_total"), F.sum(count).alias(count))


def investor_profile(daily: DataFrame, classes: DataFrame) -> DataFrame:
    """Funds per investor kind and restriction, largest first."""
    by = ["investor", "feature"]
    return funds_per(daily, classes, by).orderBy(*largest_first(by))


def latest_structure(snapshots: DataFrame, funds: DataFrame, ties: list[str]) -> DataFrame:
    """Funds per policy, mirror and feeder label, each fund counted by its latest snapshot.

    A snapshot without a date counts as the latest.  The funds are matched after each is down to one
    row, so a fund with many snapshots is no burden on the join.
    """
    last = snapshots.groupBy("fund").agg(latest_row(["policy", "mirror", "feeder"], "dt", ties, True).alias("row"))
    return (
        keep_members(last, funds, "fund", nulls_match=True)
        .select("row.*")
        .groupBy("policy", mirror_label(F.col("mirror")).alias("mirror"), feeder_label(F.col("feeder")).alias("feeder"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fee_matrix(snapshots: DataFrame, funds: DataFrame) -> DataFrame:
    """Snapshots per policy and fee flags.  The unit is the fund and date, not the fund.

    They are counted per fund before the funds are matched.
    """
    units = snapshots.select("dt", "fund", "policy", *FEES).distinct()
    per_fund = units.groupBy("fund", "policy", *FEES).agg(F.count(F.lit(1)).alias("n"))
    own = keep_members(per_fund, funds, "fund", nulls_match=True)
    counts = own.groupBy("policy", *FEES).agg(F.sum("n").alias("n"))
    return counts.withColumns({fee: fee_label(F.col(fee)) for fee in FEES})


def type_year_counts(daily: DataFrame, classes: DataFrame, first: int, last: int) -> DataFrame:
    """Funds per type and year."""
    seen = within_years(daily, first, last).select("fund", F.year("dt").alias("year")).distinct()
    typed = lookup_join(seen, classes.select("fund", "type"), "fund", "inner").distinct()
    return typed.groupBy("type", "year").agg(F.count(F.lit(1)).alias("n"))


def type_year_counts_wide(daily: DataFrame, classes: DataFrame, first: int, last: int) -> DataFrame:
    """Funds per type with one column per year."""
    years = {str(y): y for y in range(first, last + 1)}
    return wide(type_year_counts(daily, classes, first, last), ["type"], "year", "n", years, fill=0)


def qualified_types(counts: DataFrame, more_than: int = 100) -> DataFrame:
    """Types with more than the given number of funds in every year of the sample."""
    sample = F.size(F.collect_set("year").over(Window.partitionBy())).alias("sample")
    per_type = (
        counts.select("type", "n", sample)
        .groupBy("type")
        .agg(F.min("n").alias("fewest"), F.count(F.lit(1)).alias("years"), F.max("sample").alias("sample"))
    )
    return per_type.where((F.col("years") == F.col("sample")) & (F.col("fewest") > more_than)).drop("sample")


def lump_unqualified(classes: DataFrame, qualified: DataFrame) -> DataFrame:
    """Classification with every type that does not qualify folded into the rest.

    ``qualified`` has a row per type but comes from the daily rows; staged, it is known to be small.
    """
    marked = lookup_join(classes, qualified.select("type", F.col("type").alias("kept")), "type", "left")
    return marked.withColumn("type", F.coalesce("kept", F.lit(REST))).drop("kept")


def lump_types(classes: DataFrame, keep: list[str]) -> DataFrame:
    """Classification with every type outside the list folded into the rest."""
    return classes.withColumn("type", lump(F.col("type"), keep))

