"""Number formats of the report tables and chart labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(x: Column, decimals: int = 0) -> Column:
    """``1234567.8`` as ``1,234,568`` or with the wanted decimals."""
    return F.format_number(x, decimals)


def percent(x: Column, decimals: int = 2) -> Column:
    return F.concat(F.format_number(x, decimals), F.lit("%"))


def axis_percent(x: Column) -> Column:
    """Whole percent; halves go to the even number."""
    return F.concat(F.bround(x, 0).cast("bigint").cast("string"), F.lit("%"))


def reais_billions(x: Column, decimals: int = 2) -> Column:
    return F.concat(F.lit("R$ "), F.format_string(f"%.{decimals}f", x), F.lit(" bi"))
