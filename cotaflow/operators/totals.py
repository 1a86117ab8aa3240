"""Totals of a long daily table by attributes that live in a lookup table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_by_lookup(
    daily: DataFrame,
    lookup: DataFrame,
    periods: dict[str, Column],
    measures: dict[str, Column],
    by: list[str],
    rule: Callable[[Column], Column],
    weights: DataFrame | None = None,
    key: str = "fund",
) -> DataFrame:
    """Sum ``measures`` by ``periods`` and the lookup columns ``by``; facts without a match drop out.

    ``rule`` is one of the sums of ``functions.missing``.  ``weights`` (key, ``weight``) counts every
    fact of a key that many times, which is what joining a table with that many rows per key and then
    summing amounts to, without building the repeated rows.

    Rows are summed per key and period before they meet the lookup: the shuffle carries one row per key
    and period from each task, and a key that holds a large part of the rows takes no more of the join
    than any other key does.
    """
    attributes = lookup.select(key, *by)
    if weights is not None:
        attributes = attributes.join(weights.select(key, "weight"), key)
    facts = daily.select(
        key, *[c.alias(n) for n, c in periods.items()], *[c.alias(n) for n, c in measures.items()]
    )
    cells = facts.groupBy(key, *periods).agg(*[rule(F.col(m)).alias(m) for m in measures])
    joined = cells.join(attributes, key)
    if weights is not None:
        joined = joined.withColumns({m: F.col(m) * F.col("weight") for m in measures})
    return joined.groupBy(*periods, *by).agg(*[rule(F.col(m)).alias(m) for m in measures])
