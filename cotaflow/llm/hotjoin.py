"""Joining what was computed once for a value back to all rows that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A value that more than one row in HEAVY holds is met in PARTS parts; there are fewer than HEAVY such values.
HEAVY, PARTS = 1000, 64


def join_back(rows: DataFrame, values: DataFrame, column: str, copies: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``values`` beside them, where both hold the same in ``column``.

    ``values`` has each value of ``column`` once, with the number of rows that hold it in ``copies``, which is
    left out of the result; read it from a written table, since it is read three times.  The hash of a value
    that many rows hold goes to every task in a list of fewer than HEAVY; its rows are dealt over PARTS parts,
    each of which meets a copy of the value, so that no task has them all.
    """
    key, part = "_join_key", "_join_part"
    values = values.withColumn(key, F.xxhash64(column))
    total = values.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    heavy = values.where((F.col(copies) * HEAVY > int(total)) & (F.col(copies) > PARTS))
    heavy = F.broadcast(heavy.select(key, F.lit(PARTS).alias("_join_parts")).distinct())
    parts = F.coalesce("_join_parts", F.lit(1))
    dealt = rows.withColumn(key, F.xxhash64(column)).join(heavy, key, "left")
    dealt = dealt.withColumn(part, F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    met = values.drop(copies).join(heavy, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_join_parts", key).join(met.drop("_join_parts", key), [column, part], how).drop(part)
