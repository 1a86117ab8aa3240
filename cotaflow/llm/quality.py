"""Quality classifier: a regularised quadratic discriminant over document statistics.

Twenty statistics of a text, transformed towards normal shape, are taken in numpy over whole batches.  Each
class has a mean and a covariance, shrunk towards its diagonal and towards the pooled one; they come from sums
that Spark adds up over all labelled rows.  The score is the logistic of the difference of log-densities, each
from a Mahalanobis distance through the Cholesky factor of its class, which is computed once and sent to the
tasks: some kilobytes, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.llm import flat
from cotaflow.session import ship_package

#: Shares of the diagonal and of the pooled covariance in a class covariance, and the least variance.
SHRINK_DIAGONAL, SHRINK_POOLED, RIDGE = 0.1, 0.01, 1e-2
#: A class of fewer rows is not learned.
LEAST_ROWS = 2

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_KINDS = {
    "upper": np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1)),
    "digit": np.isin(np.arange(256), np.arange(ord("0"), ord("9") + 1)),
    "mark": _PUNCTUATION,
    "stop": np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8)),
    "bar": np.isin(np.arange(256), np.frombuffer(b"|<>{}[]\\/=_", np.uint8)),
    "line": np.arange(256) == 0x0A,
    "wide": np.arange(256) >= 0x80,
    "control": np.arange(256) < 0x09,
}
STATISTICS = (
    "words", "word_length", "length_spread", "upper", "digit", "mark", "stop", "bar", "line", "wide", "control",
    "mark_runs", "distinct_words", "distinct_pairs", "same_again", "distinct_lines", "short_words", "markless_words",
    "marked_words", "entropy",
)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    own = flat.mix(hashes + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(own, return_index=True)
    return np.bincount(owner[at], minlength=n).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; those of an empty text are those of no words."""
    words = flat.Words(texts)
    data, bounds, first = words.data, words.offsets, words.first
    n = len(bounds) - 1
    size = np.maximum(np.diff(bounds), 1).astype(float)
    counts = words.counts().astype(float)
    many = np.maximum(counts, 1)
    out = {"words": np.log1p(counts)}
    length = (words.ends - words.starts).astype(float)
    mean = _per_text(length, first) / many
    out["word_length"] = np.log1p(mean)
    out["length_spread"] = np.log1p(np.sqrt(np.maximum(_per_text(length**2, first) / many - mean**2, 0)))
    for kind, table in _KINDS.items():
        out[kind] = np.sqrt(_per_text(table[data], bounds) / size)
    marks = _PUNCTUATION[data]
    again = np.zeros(len(data), bool)
    again[1:] = marks[1:] & (data[1:] == data[:-1])
    out["mark_runs"] = np.sqrt(_per_text(again, bounds) / size)
    owner = words.document()
    out["distinct_words"] = (_distinct(words.hashes, owner, n) + 1) / (counts + 1)
    pairs = words.grams_of(2)[: max(len(owner) - 1, 0)]
    pair_owner = owner[: len(pairs)][pairs]
    pair_count = np.maximum(counts - 1, 0)
    out["distinct_pairs"] = (_distinct(flat.rolling(words.hashes, 2)[pairs], pair_owner, n) + 1) / (pair_count + 1)
    same = (words.hashes[1:] == words.hashes[:-1]) & pairs if len(owner) else pairs
    out["same_again"] = np.sqrt(np.bincount(owner[: len(pairs)][same], minlength=n) / many)
    lines = flat.Words(texts, np.arange(256) != 0x0A)
    line_count = lines.counts().astype(float)
    out["distinct_lines"] = (_distinct(lines.hashes, lines.document(), n) + 1) / (line_count + 1)
    out["short_words"] = _per_text(length <= 3, first) / many
    mark_sum = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    marked = mark_sum[words.ends] - mark_sum[words.starts]
    out["markless_words"] = _per_text(marked == 0, first) / many
    out["marked_words"] = np.sqrt(_per_text(marked >= 2, first) / many)
    shares = np.stack([np.bincount(data[bounds[i] : bounds[i + 1]], minlength=256) / size[i] for i in range(n)]) if n else np.zeros((0, 256))
    out["entropy"] = -(shares * np.log(np.maximum(shares, 1e-12))).sum(axis=1)
    return np.stack([out[name] for name in STATISTICS], axis=1) if n else np.zeros((0, len(STATISTICS)))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes."""

    means: list[np.ndarray]
    inverses: list[np.ndarray]
    constants: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; a class that no row was learned from never wins."""
        if not self.means:
            return np.full(len(x), 0.5)
        logs = [
            constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1)
            for mean, inverse, constant in zip(self.means, self.inverses, self.constants, strict=True)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in flat.slices(batches, "text"):
        x = statistics(batch.column("text"))
        bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))], names=["doc_id", "statistics"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, len(STATISTICS) + 1, len(STATISTICS) + 1))
    for batch in batches:
        x = _matrix(batch.column("statistics"))
        x = np.hstack((np.ones((len(x), 1)), x))
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[label == k]
            sums[k] += own.T @ own
    label, i, j = np.indices(sums.shape).reshape(3, -1)
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (label, i, j, sums.ravel())], names=["label", "i", "j", "value"])


def describe(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics) of each row of ``documents``, which ``fit`` and ``score`` take.

    Worth staging: the texts are then read once, and labels meet rows of a few numbers.  Null and empty texts
    are described as texts without words; other columns are ignored.
    """
    ship_package(documents.sparkSession)
    chosen = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(_described, f"doc_id {kind}, statistics array<double>")


def fit(described: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id") -> Discriminant:
    """The discriminant of ``labels`` (``id_col``, ``label_col`` of 0 or 1), learned from all their documents.

    Null labels and ids are left out.  Without rows of both classes every text scores one half.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("long").alias("label")).where("label in (0, 1)")
    known = described.join(marked, "doc_id").select("label", "statistics")
    sums = known.mapInArrow(_moments, "label long, i long, j long, value double")
    p = len(STATISTICS)
    total = np.zeros((2, p + 1, p + 1))
    for label, i, j, value in sums.groupBy("label", "i", "j").agg(F.sum("value")).collect():  # 2 (p + 1)^2 rows
        total[label, i, j] = value
    rows = total[:, 0, 0]
    if rows.min() < LEAST_ROWS:
        return Discriminant([], [], [])
    means = [total[k, 0, 1:] / rows[k] for k in (0, 1)]
    own = [total[k, 1:, 1:] / rows[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (own[0] * rows[0] + own[1] * rows[1]) / rows.sum()
    inverses, constants = [], []
    for k in (0, 1):
        shrunk = (1 - SHRINK_DIAGONAL) * own[k] + SHRINK_DIAGONAL * np.diag(np.diag(own[k]))
        shrunk = (1 - SHRINK_POOLED) * shrunk + SHRINK_POOLED * pooled + RIDGE * np.eye(p)
        factor = np.linalg.cholesky(shrunk)
        inverses.append(np.linalg.inv(factor))
        constants.append(float(np.log(rows[k] / rows.sum()) - np.log(np.diag(factor)).sum()))
    return Discriminant(means, inverses, constants)


def score(described: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score, predicted) of each row of ``described``: 1 where the text is likelier of label 1.

    Rows that repeat score alike; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(_matrix(batch.column("statistics")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    kind = described.schema["doc_id"].dataType.simpleString()
    return described.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
