"""Sums per fund and month, and per fund and year, that are kept up to date instead of being computed anew.

The store is two tables, both by fund: ``months``, partitioned like the daily table, and ``years``, by year.  Every month
partition has the version of the daily partition that it was computed from, a fingerprint of its files, and every year one
of its months.  When months of the daily table have been published again, only these are read; the years they lie in
are then put together from the stored months, since first and last values of a year are those of its first and
last months.  New partitions are swapped in whole (``sources.swap``), versions with them, so a refresh that fails at
any point is simply repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotaflow.functions.missing import zero_sum
from cotaflow.operators.ordered import first_value, last_value
from cotaflow.plans.base import MONTH_PARTITION, YEAR_PARTITION
from cotaflow.plans.partials import fund_months
from cotaflow.sources import swap
from cotaflow.sources.scratch import staged
from cotaflow.sources.tables import drop_partitions, in_partitions, partitions_of

PARTS = [YEAR_PARTITION, MONTH_PARTITION]
VERSION = "source_version"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """A fingerprint of the files of each partition of the daily table; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    one = F.xxhash64(F.element_at(F.split("path", "/"), -1), "length", "modificationTime")
    # A sum would overflow; files of a partition have different names, so their fingerprints don't cancel out.
    return files.groupBy(*PARTS).agg(F.bit_xor(one).alias("files"), F.count("*").alias("n")).select(*PARTS, F.xxhash64("files", "n").alias(VERSION))


def monthly(daily: DataFrame, order_by: list[str], skip_missing: bool = False) -> DataFrame:
    """``partials.fund_months`` of dated and undated rows with what a year needs of them.

    First and last quota and last balance by ``order_by``, which begins with the date, the last day, and the net flow
    that counts missing days as nothing.
    """
    ends = daily.groupBy("fund", *PARTS).agg(
        first_value("quota", order_by, skip_missing).alias("start"),
        last_value("quota", order_by, skip_missing).alias("end"),
        last_value("balance", order_by).alias("last_balance"),
        F.max("dt").alias("last_dt"),
        zero_sum(F.col("inflow") - F.col("outflow")).alias("net_zero"),
    )
    sums = fund_months(daily).withColumns({YEAR_PARTITION: F.year("dt"), MONTH_PARTITION: F.month("dt")})
    same = [sums[c].eqNullSafe(ends[c]) for c in ("fund", *PARTS)]
    return sums.join(ends, same[0] & same[1] & same[2]).select(*(sums[c] for c in sums.columns), *(c for c in ends.columns if c not in ("fund", *PARTS)))


def yearly(months: DataFrame, skip_missing: bool = False) -> DataFrame:
    """``partials.fund_years`` from stored months; undated rows have no year."""
    dated = months.where(F.col("dt").isNotNull())
    return dated.groupBy("fund", F.col(YEAR_PARTITION).alias("year")).agg(
        first_value("start", ["dt"], skip_missing).alias("start"),
        last_value("end", ["dt"], skip_missing).alias("end"),
        last_value("last_balance", ["dt"]).alias("balance"),
        F.max("last_dt").alias("dt"),
        F.sum("net_zero").alias("net"),
    )


def months(spark: SparkSession, store: str) -> DataFrame:
    """The stored sums per fund and month, as ``partials.fund_months`` has them."""
    kept = spark.read.parquet(f"{store}/months")
    return kept.drop(VERSION, *PARTS, "start", "end", "last_balance", "last_dt", "net_zero")


def years(spark: SparkSession, store: str) -> DataFrame:
    """The stored values per fund and year, as ``partials.fund_years`` has them."""
    return spark.read.parquet(f"{store}/years").drop(VERSION)


def _changed(now: DataFrame, stored: DataFrame | None, parts: list[str]) -> tuple[list[tuple], list[tuple]]:
    """The partitions that ``stored`` lacks or has of another version, and those that it has and ``now`` lacks."""
    if stored is None:
        return partitions_of(now, parts), []
    now, have = staged(now, "versions"), staged(stored.select(*parts, VERSION).distinct(), "stored-versions")
    same = reduce(Column.__and__, [now[c].eqNullSafe(have[c]) for c in parts])
    new = now.join(have, same & (now[VERSION] == have[VERSION]), "left_anti")
    return partitions_of(new, parts), partitions_of(have.join(now, same, "left_anti"), parts)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if any("=" in n for n in swap.folders(spark, path)) else None


def _year_versions(kept: DataFrame) -> DataFrame:
    """A fingerprint of the months that each year is put together from."""
    of_months = kept.where(F.col(YEAR_PARTITION).isNotNull()).select(*PARTS, VERSION).distinct()
    one = F.bit_xor(F.xxhash64(MONTH_PARTITION, VERSION)).alias("months")
    return of_months.groupBy(F.col(YEAR_PARTITION).alias("year")).agg(one, F.count("*").alias("n")).select("year", F.xxhash64("months", "n").alias(VERSION))


def refresh(spark: SparkSession, path: str, store: str, order_by: list[str], skip_missing: bool = False) -> list[tuple]:
    """Bring the store up to date with the daily table at ``path``; the months that were computed anew or went.

    The first call computes everything.  ``order_by`` and ``skip_missing`` must stay the same for a store.
    """
    for part in ("months", "years"):
        swap.repair(spark, f"{store}/{part}")
    now = versions(spark, path)
    new, gone = _changed(now, _stored(spark, f"{store}/months"), PARTS)
    if new:
        found = monthly(spark.read.parquet(path).where(in_partitions(new, PARTS)), order_by, skip_missing)
        same = [found[c].eqNullSafe(now[c]) for c in PARTS]
        found = found.join(now, same[0] & same[1]).select(*(found[c] for c in found.columns), VERSION)
        _put(spark, found, f"{store}/months", PARTS)
    drop_partitions(spark, f"{store}/months", gone, PARTS)

    kept = _stored(spark, f"{store}/months")
    if kept is not None:
        now = _year_versions(kept)
        touched, ended = _changed(now, _stored(spark, f"{store}/years"), ["year"])
        if touched:
            found = yearly(kept.where(in_partitions(touched, [YEAR_PARTITION])), skip_missing)
            _put(spark, found.join(now, "year"), f"{store}/years", ["year"])
        drop_partitions(spark, f"{store}/years", ended, ["year"])
    return sorted([*new, *gone], key=repr)


def _put(spark: SparkSession, df: DataFrame, path: str, parts: list[str]) -> None:
    beside = swap.beside(spark, path)
    df.hint("rebalance", *[F.col(c) for c in parts]).write.partitionBy(*parts).parquet(beside)
    swap.swap_in(spark, path, beside, len(parts))
