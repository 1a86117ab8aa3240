"""Words of many texts as flat numpy arrays.

The functions here run inside Spark tasks, on the Arrow batches of ``mapInArrow``.  A batch of texts is one
byte buffer with offsets; words are found and hashed over the whole buffer at once, without a Python object
per word.  Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes hashed at a time; keeps the arrays of eight bytes per byte of text within a few megabytes.
CHUNK = 1 << 18
#: Bytes of text that a task takes from a batch at a time.
SLICE = 4 << 20

_BASE, _BASE_K, _BASE_K2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407
_TABLE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_powers = {"n": 0}


def _is_word(separators) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
NON_SPACE = _is_word([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text; A-Z count as their small letters.
LETTERS = _is_word([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_table(lower: bool) -> np.ndarray:
    table = _TABLE.copy()
    if lower:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each starts; one more offset marks the end."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width, len(texts) + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: ``hashes``; ``first[i]`` to ``first[i + 1]`` are the words of text i; byte range of each."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray = NON_SPACE, lower: bool = False, hashed: bool = True):
        data, offsets = buffer(texts)
        self.data, self.offsets = data, offsets
        mask = is_word[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = False, mask[:-1]
            after[-1], after[:-1] = False, mask[1:]
        self.starts = np.flatnonzero(mask & (~before | cut[:-1]))
        self.ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash(lower_table(lower)) if hashed else np.zeros(0, np.uint64)

    def _hash(self, table: np.ndarray) -> np.ndarray:
        starts, ends = self.starts, self.ends
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
            low = starts[i]
            part = self.data[low : ends[j - 1]]
            up, down = _power_tables(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * up[: len(part)], out=total[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def grams_of(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one text."""
        left = np.repeat(self.first[1:], self.counts()) - np.arange(len(self.hashes))
        return left >= k


def rolling(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A hash of every k neighbours, by doubling; shorter by k - 1, empty with fewer than k."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    base = _BASE_K2 if second else _BASE_K
    size = len(hashes) - k + 1
    out, have = None, 0
    block, width = hashes, 1
    while True:
        if k & width:
            piece = block[have : have + size]
            out = piece.copy() if out is None else out * np.uint64(pow(base, width, 2**64)) + piece
            have += width
        if width * 2 > k:
            break
        block = block[:-width] * np.uint64(pow(base, width, 2**64)) + block[width:]
        width *= 2
    return mix(out + np.uint64(k))


def sliding(values: np.ndarray, k: int, best) -> np.ndarray:
    """The least (``np.minimum``) or largest of every k neighbours; shorter by k - 1."""
    if len(values) < k:
        return values[:0]
    block, width = values, 1
    while width * 2 <= k:
        block = best(block[:-width], block[width:])
        width *= 2
    size = len(values) - k + 1
    return best(block[:size], block[k - width : k - width + size])


def slices(batches, texts: str, most: int = SLICE):
    """The batches again, cut so that a piece holds ``most`` bytes of text, or one longer text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(texts))
        _, offsets = buffer(column)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(values.view(np.int64), pa.int64())


def carried(names) -> Column:
    """Columns that an operator hands on unread, as one struct, so that no name clashes with its own."""
    return F.struct(*(F.col(n) for n in names) if names else [F.lit(None).alias("none")]).alias("row")


def with_row(frame: DataFrame, ddl: str) -> StructType:
    """The schema of ``ddl`` and the column ``row`` of ``frame``."""
    return StructType([*StructType.fromDDL(ddl).fields, frame.schema["row"]])
