"""Whitened embeddings from a covariance weighted by multiplicity.

Identical vectors are one row with a count from the start.  The covariance is a product of matrices over these
distinct rows: centred before multiplying, each row weighted by its count, or by one.  Every distinct row
is then projected and scaled once, and the result joined back to all rows that hold it.

Components are held to whole numbers first, ``x = floor(scale * c) + shift``, so that rows that are equal after
rounding are one, and sums and deviations are exact: a mean is the whole number ``base`` and the remainder
``rest / n``.  Tasks hand over one matrix each, of the size of the dimensions squared; only that sum comes to
the driver, whose eigenvectors go back to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotaflow.llm.hotjoin import join_back
from cotaflow.session import ship_package
from cotaflow.sources.scratch import Staging, staged

SCALE, SHIFT = 64, 1_000_000
#: Entries at or beyond it have no exact whole number in double precision; their rows take no part.
LARGEST = 2.0**46
#: Eigenvalues below this share of the largest, times the dimensions, count as zero.
FLAT = 8 * np.finfo(float).eps
#: Low bits that are summed apart, so that sums of products stay within a long.
_LOW = 26


@dataclass(frozen=True)
class Whitening:
    """What the fit found: ``n`` rows, means ``base + rest / n``, eigenvalues falling, unit eigenvectors as columns."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.rest.astype(float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Components of rows; NaN along an axis without variance."""
        least = FLAT * len(self.base) * (self.values[0] if len(self.values) else 0.0)
        scale = np.where(self.values > least, 1 / np.sqrt(np.where(self.values > least, self.values, 1.0)), np.nan)
        return self.centred(x) @ self.axes * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) squared, exactly."""
        y = x - self.base
        if len(y) and np.abs(y).max() * max(np.abs(y).max(), self.n) >= 2**62 // max(1, len(self.base)):
            y = y.astype(object)
        squares, mixed = (y * y).sum(axis=1), (y * self.rest).sum(axis=1)
        own = sum(int(r) ** 2 for r in self.rest)
        return [self.n * (self.n * int(a) - 2 * int(b)) + own for a, b in zip(squares, mixed, strict=True)]

    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values]


def whole_numbers(vectors: DataFrame, vector_col: str, carry: Column) -> DataFrame:
    """(row, x) of the rows whose vector is neither null nor empty and holds finite entries only."""

    def usable(c: Column) -> Column:
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)

    rows = vectors.select(carry.alias("row"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", usable))
    return rows.select("row", F.transform("vector", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch, column: str, kind=np.int64) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy().astype(kind, copy=False).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x, weight = _matrix(batch, "x"), batch.column("weight").to_numpy()
            own = np.stack([(part * weight[:, None]).sum(axis=0) for part in (x >> _LOW, x & ((1 << _LOW) - 1))])
            total = own if total is None else total + own
    if total is not None:
        names = ["at", "high", "low"]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1]), pa.int64()), *(pa.array(t) for t in total)], names=names)


def _products(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The upper half of the weighted sum of products, of one task."""
    total = None
    for z, weight in rows:
        own = z.T @ (z * weight[:, None])
        total = own if total is None else total + own
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total[i, j])], names=["i", "j", "value"])


def _gram(rows: DataFrame, run, size: int) -> np.ndarray:
    """Sum of the tasks' products as a whole matrix; its entries are all that comes to the driver."""
    found = rows.mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    total = np.zeros((size, size))
    for i, j, value in found.collect():
        total[i, j] = total[j, i] = value
    return total


def fit(distinct: DataFrame, components: int = 32) -> Whitening:
    """The leading components of ``distinct``, rows of whole numbers ``x``, all of one length, with a ``weight``."""
    exact = "decimal(38,0)"
    n = int(distinct.agg(F.sum(F.col("weight").cast(exact))).first()[0] or 0)
    sums = distinct.select("x", "weight").mapInArrow(_sums, "at long, high long, low long")
    sums = sums.groupBy("at").agg(F.sum(F.col("high").cast(exact)).alias("high"), F.sum(F.col("low").cast(exact)).alias("low"))
    totals = {at: (int(high) << _LOW) + int(low) for at, high, low in sums.collect()}  # one row a dimension
    totals = [totals[k] for k in range(len(totals))]
    base, rest = np.array([s // n for s in totals], np.int64), np.array([s % n for s in totals], np.int64)
    model = Whitening(n, base, rest, np.zeros(0), np.zeros((len(base), 0)), 0.0)
    if not n:
        return model

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _products((model.centred(_matrix(b, "x")), b.column("weight").to_numpy().astype(float)) for b in batches if b.num_rows)

    covariance = _gram(distinct.select("x", "weight"), centred, len(base)) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components].copy(), axes[:, ::-1][:, :components].copy()
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, base, rest, np.maximum(values, 0.0), axes, float(np.trace(covariance)))


def _identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, over the axes that have variance."""
    k = len(model.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for_one = ((np.hstack((_matrix(b, "whitened", float), np.ones((b.num_rows, 1)))), b.column("weight").to_numpy()) for b in batches if b.num_rows)
        return _products(for_one)

    total = _gram(whitened.select("whitened", "weight"), products, k + 1) / model.n
    covariance = total[:k, :k] - np.outer(total[:k, k], total[:k, k])
    errors = np.abs(covariance - np.eye(k))
    return float(np.nanmax(errors)) if np.isfinite(errors).any() else None


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 32,
    weights: str = "counts",
) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of each row of ``vectors`` that takes part.

    ``whitened`` and ``explained`` are arrays with an entry for each of the first ``components`` axes by falling
    variance; ``deviation`` is decimal(38,0), the exact sum of (n x - S) squared, and null beyond 38 digits.
    ``weights`` says whether the fit counts a vector as often as it occurs ("counts") or once ("one"); ``n`` is
    the number fitted.

    Rows whose vector is null, empty, or holds an entry that is null, not finite or of 2^46 and more take no
    part, nor do rows of another length than most have (the longer length where two are equally frequent).
    Rows that repeat, null ids too, all come back with the same values; the sign of an axis makes its largest
    entry positive.  Along an axis without variance ``whitened`` is null, and ``explained`` is null where nothing
    varies.  No rows give no rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    if weights not in ("counts", "one"):
        raise ValueError(f"weights: {weights}")
    rows = whole_numbers(vectors, vector_col, F.col(id_col))
    empty = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}"
    output = f"{empty}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    with Staging(spark) as stage:
        groups = stage(rows.groupBy("x").agg(F.count("*").alias("copies")), "distinct-vectors")
        lengths = groups.groupBy(F.size("x").alias("length")).agg(F.sum("copies").alias("rows"))
        usual = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
        if usual is None:
            return spark.createDataFrame([], output)
        weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
        distinct = groups.where(F.size("x") == usual["length"]).withColumn("weight", weight)
        model = fit(distinct, components)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch, "x")
                found = model.whitened(x)
                bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1], pa.int32())
                sizes = [str(d) if d < 10**38 else None for d in model.deviations(x)]
                columns = [batch.column("x"), batch.column("copies"), batch.column("weight"), pa.array(sizes, pa.string())]
                lists = pa.ListArray.from_arrays(bounds, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["x", "copies", "weight", "deviation", "whitened"])

        schema = "x array<bigint>, copies long, weight long, deviation string, whitened array<double>"
        whitened = staged(distinct.mapInArrow(project, schema), "whitened")
        error = _identity_error(whitened, model)

    null_where_flat = F.transform("whitened", lambda w: F.when(~F.isnan(w), w))
    explained = F.array(*(F.lit(v).cast("double") for v in model.explained()))
    return join_back(rows, whitened.drop("weight"), "x", "copies").select(
        F.col("row").alias(id_col),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        null_where_flat.alias("whitened"),
        explained.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
