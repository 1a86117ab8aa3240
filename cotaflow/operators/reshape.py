"""Long to wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(
    df: DataFrame,
    ids: list[str],
    names: str,
    values: str,
    columns: dict[str, object],
    fill: float | int | None = None,
    total: str | None = None,
    others: bool = False,
) -> DataFrame:
    """One column per listed value of ``names``, holding ``values``.

    ``columns`` maps the new column name to the value it collects; naming them saves the job that
    would look them up.  A value that is not listed is an error, unless ``others`` says that there may be
    such.  ``fill`` replaces cells that have no row; a NULL that is present stays.  ``total`` names a
    column for the sum of all rows.
    """
    listed = F.coalesce(F.col(names).isin(list(columns.values())), F.lit(False))
    stray = F.max(F.when(~listed, F.coalesce(F.col(names).cast("string"), F.lit("NULL"))))
    complaint = F.raise_error(F.concat(F.lit(f"{names} has a value without a column: "), stray))
    cells = []
    for name, wanted in columns.items():
        hit = F.col(names) == F.lit(wanted)
        cell = F.max(F.when(hit, F.col(values)))
        if fill is not None:
            cell = F.when(F.count_if(hit) == 0, F.lit(fill)).otherwise(cell)
        if not others:
            cell = F.when(stray.isNotNull(), complaint.cast(df.schema[values].dataType)).otherwise(cell)
        cells.append(cell.alias(name))
    if total is not None:
        cells.append(F.coalesce(F.sum(values), F.lit(0.0)).alias(total))
    return df.groupBy(*ids).agg(*cells)


def row_total(columns: list[str]) -> Column:
    """Sum across columns, missing cells counted as zero."""
    total = F.lit(0.0)
    for name in columns:
        total = total + F.coalesce(F.col(name), F.lit(0.0))
    return total


def numeric_columns(df: DataFrame, leave_out: list[str] | None = None) -> list[str]:
    """Names of the numeric columns."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [n for n, t in df.dtypes if t.startswith(numeric) and n not in (leave_out or [])]
