"""Sorting, top groups and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def largest_groups(counts: DataFrame, key: str, count: str, k: int) -> DataFrame:
    """The ``k`` groups with the highest count; equal counts go by key."""
    return counts.orderBy(F.desc_nulls_last(count), F.asc_nulls_last(key)).limit(k)


def page(df: DataFrame, newest: str, ties: list[str], size: int, number: int = 0) -> DataFrame:
    """Page ``number`` (from 0) of the rows in order of ``newest``, latest first."""
    order = [F.desc_nulls_last(newest), *[F.asc_nulls_last(t) for t in ties]]
    return df.orderBy(*order).offset(size * number).limit(size)
