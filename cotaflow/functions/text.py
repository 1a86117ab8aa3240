"""Identifier cleaning and text building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_only(x: Column) -> Column:
    """Keep only the digits of an identifier; leading zeros stay because the result is text."""
    return F.regexp_replace(x, "[^0-9]", "")


def drop_marks(x: Column, marks: str = "./-") -> Column:
    """Remove each of the given characters wherever it occurs."""
    return F.translate(x, marks, "")


def short_name(x: Column, prefix: str) -> Column:
    """Cut ``prefix`` and the blanks after it from the start of a name, when it starts with it."""
    return F.when(x.startswith(prefix), F.regexp_replace(x, rf"^\Q{prefix}\E\s+", "")).otherwise(x)


def paste(*parts: Column, sep: str = " ") -> Column:
    """Join texts; a missing part is written as ``NA`` instead of making the result missing."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def word_count(x: Column) -> Column:
    """Number of blank-separated words."""
    return F.regexp_count(x, F.lit(r"\S+"))
