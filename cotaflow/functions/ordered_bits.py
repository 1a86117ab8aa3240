"""Doubles as whole numbers in the same order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exponents of the least and of the largest normal double.
LEAST, LARGEST = -1022, 1023


def with_ordered_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with a long for each double, in the same order and different for different numbers.

    It is the number's 64 bits with the sign applied: exponent above 52 bits of the fraction; -0.0 is 0.0, and
    NaN and NULL are NULL.  Both come from exact steps only: scaling by powers of two, and a logarithm whose
    rounding is put right by comparison.  The steps are columns of their own, so that none is worked out twice.
    """
    steps = [
        f"abs(`{value}`) AS __size",
        f"cast(least(greatest(floor(log2(__size)), {LEAST}), {LARGEST}) AS int) AS __guess",
        f"""CASE WHEN power(2D, cast(__guess AS double)) > __size THEN greatest(__guess - 1, {LEAST})
            WHEN __guess < {LARGEST} AND power(2D, cast(__guess + 1 AS double)) <= __size THEN __guess + 1
            ELSE __guess END AS __exponent""",
        # Two factors, since one power of two could be too large for a double.
        "shiftright(52 - __exponent, 1) AS __half",
        "__size * power(2D, cast(__half AS double)) * power(2D, cast(52 - __exponent - __half AS double)) AS __fraction",
        # Numbers below the least normal one lack the leading bit, so they fall into place below it.
        f"""CASE WHEN isnan(__size) THEN NULL WHEN __size = 0 THEN 0L WHEN __size = double('Infinity') THEN {2047 << 52}L
            ELSE cast(__exponent - {LEAST} AS bigint) * {1 << 52}L + cast(__fraction AS bigint) END AS __bits""",
        f"CASE WHEN NOT isnan(`{value}`) THEN CASE WHEN `{value}` < 0 THEN -__bits ELSE __bits END END AS `{name}`",
    ]
    return df.selectExpr("*", *steps).select(*df.columns, F.col(name))
