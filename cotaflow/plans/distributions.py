"""How returns are spread within a type and year, against a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.operators.distribution import QUARTILES, box_stats, group_stats
from cotaflow.operators.joins import calendar_join
from cotaflow.operators.windows import level_code

FACET = ["type", "year"]


def return_quartiles(marked: DataFrame, method: str = "radix") -> DataFrame:
    """Quartiles per type and year beside the benchmark line of the chart.

    ``marked`` holds fund-years with ``is_out``; rows of other facets are to be filtered out before.
    The line covers every facet, also one whose funds are all outliers, and ``position`` counts the
    years present, so it shifts when a year is absent.  Both come from the same pass.
    """
    kept = marked.withColumn("ret", F.when(~F.col("is_out"), F.col("ret")))
    stats = group_stats(kept, [*FACET, "benchmark"], "ret", QUARTILES, method)
    return stats.select(*FACET, "benchmark", level_code("year").alias("position"), "n", *QUARTILES)


def return_boxes(trimmed: DataFrame, benchmark: DataFrame, method: str = "radix") -> DataFrame:
    """Box-plot numbers per type and year with the benchmark and the axis position."""
    boxes = box_stats(trimmed, ["type_short", *FACET], "ret", method)
    return calendar_join(boxes.withColumn("position", level_code("year")), benchmark)
