"""Consolidated tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotaflow.sources import swap

MODES = {"create": "errorifexists", "replace": "overwrite", "restate": "overwrite"}


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "create",
    partition_by: list[str] | str | None = None,
    cluster_by: list[str] | None = None,
    covers: list[str] | None = None,
) -> None:
    """Write a Parquet table.

    ``create`` refuses an existing table, ``replace`` rewrites all of it, ``restate`` rewrites only the
    partitions that occur in ``df``, for months that are published again whole.  Restating needs ``covers``,
    columns such as the fund and the day: a partition is only rewritten if ``df`` has every combination of them that the
    table has there, so that a part of a partition can't take the place of all of it; rows without a
    partition, such as undated ones, are refused.  ``merge_table`` takes parts of partitions.

    Rows are rebalanced by partition before writing, which splits a partition that holds most of the
    rows over several files and puts small ones together, without a look at the rows beforehand.  With
    ``cluster_by`` each file is sorted, so rows of equal keys lie side by side and later totals per key
    shrink before any shuffle.
    """
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if mode == "restate":
        if not parts or not covers:
            raise ValueError("restating needs partition columns and the columns that must be covered")
        if not df.where(_any_null(parts)).isEmpty():
            raise ValueError(f"the restated rows have some without {parts}; nothing was written")
        _check_coverage(df, path, parts, covers)
    writer = _arranged(df, parts, cluster_by).write.mode(MODES[mode])
    if parts:
        writer = writer.partitionBy(*parts)
    if mode == "restate":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _arranged(df: DataFrame, parts: list[str], cluster_by: list[str] | None) -> DataFrame:
    if parts:
        df = df.hint("rebalance", *[F.col(c) for c in parts])
    return df.sortWithinPartitions(*parts, *cluster_by) if cluster_by else df


def _any_null(columns: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(c).isNull() for c in columns])


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in columns])


def _check_coverage(df: DataFrame, path: str, parts: list[str], covers: list[str]) -> None:
    """Raise if ``df`` lacks a combination of ``covers`` in a partition that it would rewrite; missing values count."""
    new = df.select(*parts, *covers).distinct()
    old = df.sparkSession.read.parquet(path).select(*parts, *covers).distinct()
    touched = new.select(*parts).distinct()
    old = old.join(touched, _same(old, touched, parts), "left_semi")
    lost = old.join(new, _same(old, new, [*parts, *covers]), "left_anti")
    if found := lost.first():
        raise ValueError(f"the table has {found.asDict()}, which the restated rows lack; nothing was written")


def in_partitions(values: list[tuple], parts: list[str]) -> Column:
    """Rows of the listed partitions, as a condition that the reader prunes folders by; missing values count."""

    def one(row: tuple) -> Column:
        return reduce(Column.__and__, [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in zip(parts, row, strict=True)])

    return reduce(Column.__or__, [one(v) for v in values], F.lit(False))


def partitions_of(df: DataFrame, parts: list[str]) -> list[tuple]:
    """The partitions that occur in ``df``: as many as folders that will be written, which the driver handles one by one."""
    return sorted((tuple(r) for r in df.select(*parts).distinct().toLocalIterator()), key=repr)


def merge_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | str,
    keys: list[str],
    cluster_by: list[str] | None = None,
    absent: str = "keep",
    unkeyed: str = "refuse",
) -> list[tuple]:
    """Merge rows that are published again into a table by their keys, such as fund and day; the partitions rewritten.

    Where the table has rows of a key that ``df`` has, those of ``df`` take their place, all of them.  Rows of the
    table whose key is not in ``df`` stay with ``absent="keep"``; with ``"end"`` they go, from the
    partitions that occur in ``df`` and nowhere else.  Rows without a key, such as undated ones, never
    replace any and are never ended: those of the table stay, and those of ``df`` are refused (``unkeyed="refuse"``) or added
    (``"add"``) as often as the table does not have the same row yet, so that a second run changes nothing.

    The rewritten partitions are first written whole beside the table and then swapped in one by one
    (``sources.swap``): a write that fails changes nothing, and a swap that is cut short is ended by the next merge.
    No rows leave the table as it is.  The table's columns are taken by name.
    """
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    if absent not in ("keep", "end") or unkeyed not in ("refuse", "add"):
        raise ValueError(f"absent={absent!r}, unkeyed={unkeyed!r}")
    spark = df.sparkSession
    swap.repair(spark, path)
    table = spark.read.parquet(path)
    new = df.select(*table.columns)
    without_key = _any_null([*parts, *keys])
    if unkeyed == "refuse" and not new.where(without_key).isEmpty():
        raise ValueError(f"rows without {[*parts, *keys]}; nothing was written")
    touched = partitions_of(new, parts)
    if not touched:
        return []
    old = table.where(in_partitions(touched, parts))
    keyed = new.where(~without_key)
    published = keyed.select(*parts, *keys).distinct()
    if absent == "keep":
        stay = old.join(published, _same(old, published, [*parts, *keys]), "left_anti")
    else:
        # A partition that only rows without a key occur in has nothing published again.
        whole = published.select(*parts).distinct()
        stay = old.where(without_key).unionByName(old.where(~without_key).join(whole, _same(old, whole, parts), "left_anti"))
    merged = stay.unionByName(keyed).unionByName(new.where(without_key).exceptAll(old.where(without_key)))
    beside = swap.beside(spark, path)
    _arranged(merged, parts, cluster_by).write.partitionBy(*parts).parquet(beside)
    swap.swap_in(spark, path, beside, len(parts))
    return touched


def drop_partitions(spark: SparkSession, path: str, values: list[tuple], parts: list[str]) -> None:
    """Delete whole partitions of a table."""
    for row in values:
        swap.remove(spark, path, "/".join(f"{c}={swap.DEFAULT if v is None else v}" for c, v in zip(parts, row, strict=True)))
