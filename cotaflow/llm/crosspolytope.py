"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by three rounds of random signs and a fast Hadamard transform and gives each to the
nearest signed axis.  Every row is indexed once, with its axis in each of ``TABLES`` tables.  A query is turned the
same way and has a score on every axis of every table: how near it is to that axis.  Its probes are taken over all
tables together, by the sum of its scores on the axes of a vector, times the vector's length: an estimate of the inner
product from a few table look-ups.  Only the share ``PROBES`` of the vectors with the best estimates is held
against the query by exact inner products.

Vectors and queries meet in blocks of a bounded number of either, dealt by id, so no axis and no common vector
makes a large task: more rows make more blocks.  A block hands on a query's best few.  Of vectors that are exactly
equal only as many as a result can hold are searched, by id.

Recall of the 20 nearest against brute force on the test tables, whose vectors are nearly random, is above 0.97 at 2000
vectors with a quarter of the inner products; tests measure it.  Blocks of few vectors are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotaflow.llm import flat
from cotaflow.session import ship_package
from cotaflow.sources.scratch import Staging, staged

TABLES = 12
#: Share of a block's vectors that a query is held against, and the least number of them, in results asked for.
PROBES, LEAST = 0.25, 10
#: Most vectors and queries of a block, about, and queries that are estimated at a time.
BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 4096, 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def axes(x: np.ndarray, table: int) -> np.ndarray:
    """Each row against all signed axes of a table's rotation: the positive ones, then the negative ones."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    turned = np.zeros((len(x), width))
    turned[:, : x.shape[1]] = x
    signs = np.random.default_rng([8, table]).choice([-1.0, 1.0], (3, width))
    for row in signs:
        turned = hadamard(turned * row)
    return np.hstack((turned, -turned))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal dimension, and their vectors as doubles."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(bounds)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[bounds[rows][:, None] + np.arange(size)]


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one and their lengths, also where squares are too large or too small for doubles."""
    most = np.abs(x).max(axis=1)
    scaled = x / most[:, None]
    norms = np.linalg.norm(scaled, axis=1)
    return scaled / norms[:, None], np.minimum(norms * np.minimum(most, 1e300), 1e300)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in _vectors(batch.column("vector")) if batch.num_rows else ():
            unit, _ = _unit(x)
            codes = np.stack([axes(unit, table).argmax(axis=1) for table in range(TABLES)], axis=1).astype(np.int32)
            bounds = np.arange(len(rows) + 1, dtype=np.int32) * TABLES
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), x.shape[1], np.int32)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(codes.ravel())),
                    batch.column("id").take(taken),
                    batch.column("vector").take(taken),
                ],
                names=["dim", "axes", "id", "vector"],
            )


def estimates(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """For each query (of length one) and each vector: the query's scores on the vector's axes, times its length."""
    total = np.zeros((len(queries), len(codes)))
    for table in range(codes.shape[1]):
        total += axes(queries, table)[:, codes[:, table]]
    return total * norms


def usable(vector: str, element: str) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast(element)))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each row of ``vectors`` where ``queries`` holds.

    ``score`` is the inner product of the original vectors in double precision; the largest is rank 1, ties go
    to the smaller ``vec_id``.  All other rows are candidates, never those of the query's own id.  Vectors that
    are null, zero, or hold a null, NaN or infinite component take no part, neither do null ids; vectors of
    another dimension than the query's are not found by it.  With fewer candidates than ``k``, small tables
    give what there is.  Repeated rows of one id count once in a result.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    element = element if element in ("float", "double") else "double"
    kind = f"array<{element}>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("vector", element))
    keep = 2 * k + 1

    def search(key: tuple, points: pa.Table, asks: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        points, asks = points.combine_chunks(), asks.combine_chunks()
        if points.num_rows and asks.num_rows:
            (_, x), = _vectors(_list(points, "vector"))
            (_, q), = _vectors(_list(asks, "vector"))
            ids, names = points.column("id").to_numpy(), asks.column("id").to_numpy()
            codes = _list(points, "axes").values.to_numpy().reshape(len(x), TABLES)
            (_, norms), (turned, _) = _unit(x), _unit(q)
            most = min(len(x), max(int(np.ceil(PROBES * len(x))), LEAST * k))
            for first in range(0, len(q), AT_ONCE):
                own = slice(first, first + AT_ONCE)
                if most < len(x):
                    near = estimates(turned[own], codes, norms)
                    near[names[own][:, None] == ids[None, :]] = -np.inf
                    probed = np.argpartition(-near, most - 1, axis=1)[:, :most]
                else:
                    probed = np.broadcast_to(np.arange(len(x)), (len(q[own]), len(x)))
                for i, which in enumerate(probed, first):
                    which = which[ids[which] != names[i]]
                    scores = x[which] @ q[i]
                    if len(which) > keep:
                        which = which[np.argpartition(-scores, keep - 1)[:keep]]
                    # Row by row, so that equal vectors score equally wherever they are.
                    found.append((np.full(len(which), names[i]), ids[which], (q[i] * x[which]).sum(axis=1)))
        parts = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, float))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))

    with Staging(spark) as stage:
        # Of equal vectors only the first few ids can be in a result.
        copies = Window.partitionBy("vector").orderBy("id")
        searched = rows.select("id", "vector").distinct().withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy")
        points = stage(searched.mapInArrow(_index, f"dim int, axes array<int>, id long, vector {kind}"), "points")
        asks = stage(rows.where("asks").select(F.size("vector").alias("dim"), "id", "vector").distinct(), "asking")
        # One row for each dimension.
        loads = points.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        asked = asks.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
        loads = stage(loads.join(asked, "dim"), "loads")
        spread = F.xxhash64("id", "vector")
        dealt = points.join(loads, "dim").withColumn("block", F.pmod(spread, F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
        sent = asks.join(loads, "dim").withColumn("query_block", F.pmod(spread, F.col("query_blocks")).cast("int"))
        sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        task = ["dim", "block", "query_block"]
        dealt = dealt.select(*task, "axes", "id", "vector").groupBy(*task)
        found = dealt.cogroup(sent.select(*task, "id", "vector").groupBy(*task))
        found = found.applyInArrow(search, "query_id long, vec_id long, score double")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
        return staged(best.select("query_id", "rank", "vec_id", "score"), "nearest")


def _list(table: pa.Table, name: str) -> pa.ListArray:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
