"""Joins of a long fact to lookup tables and key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_key(left: Column, right: Column, nulls_match: bool) -> Column:
    return left.eqNullSafe(right) if nulls_match else left == right


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: list[str] | str,
    how: str = "left",
    nulls_match: bool = False,
) -> DataFrame:
    """Join a lookup table on equally named keys, keeping one copy of each key.

    A lookup with several rows per key repeats the fact rows.  ``nulls_match`` lets a missing key
    find a missing key, as joins of in-memory tables do in the studies; database joins do not.
    The planner broadcasts a side that it knows to be small; else it splits hot keys, provided neither side
    comes straight out of an aggregation by the key; stage such a side when the other one is raw rows.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if not nulls_match:
        return fact.join(lookup, keys, how)
    other = lookup.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return fact.join(other, condition, how).drop(*[f"__{k}" for k in keys])


def keep_members(df: DataFrame, members: DataFrame, key: str, nulls_match: bool = False) -> DataFrame:
    """Rows whose key occurs in ``members`` (semi join), which may repeat a key."""
    return _membership(df, members, key, "left_semi", nulls_match)


def drop_members(df: DataFrame, members: DataFrame, key: str, nulls_match: bool = True) -> DataFrame:
    """Rows whose key does not occur in ``members`` (anti join); a missing key alone is no reason to go."""
    return _membership(df, members, key, "left_anti", nulls_match)


def _membership(df: DataFrame, members: DataFrame, key: str, how: str, nulls_match: bool) -> DataFrame:
    keys = members.select(F.col(key).alias("__member"))
    return df.join(keys, same_key(F.col(key), F.col("__member"), nulls_match), how)


def calendar_join(df: DataFrame, yearly: DataFrame, on: str = "year") -> DataFrame:
    """Left join of a table with one row per calendar period."""
    return df.join(yearly, on, "left")
