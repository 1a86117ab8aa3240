"""Recoding of flags and categories to the labels the reports show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and flag codes of the published reports.
YES, NO = "Sim", "Não"
FLAG_YES, FLAG_NO = "S", "N"
REST = "Outros"
ONGOING = "Atual"


def mirror_label(flag: Column) -> Column:
    """Yes/no label where a missing flag means no."""
    return F.when(flag.isNull() | (flag == FLAG_NO), NO).otherwise(YES)


def feeder_label(flag: Column) -> Column:
    """Yes/no label where a missing flag means yes."""
    return F.when(flag == FLAG_NO, NO).otherwise(YES)


def fee_label(flag: Column) -> Column:
    """Yes/no label that leaves any other value, missing included, as it is."""
    return F.when(flag == FLAG_YES, YES).when(flag == FLAG_NO, NO).otherwise(flag)


def lump(value: Column, keep: list[str], rest: str = REST) -> Column:
    """Keep the listed categories and fold all others, missing included, into ``rest``."""
    return F.when(value.isin(keep), value).otherwise(rest)
