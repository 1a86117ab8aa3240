"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A slice of texts is cut into pieces; pieces not met before are encoded together.  All their symbols lie in one
flat array.  A round packs neighbouring symbols into pair keys, finds their ranks by binary search in the
sorted keys of the merge table, takes the lowest rank of each piece and merges all its places; pieces without
a pair in the table are done and leave the array.  A text's ids are the joined ids of its pieces.  Decoding
gathers the bytes of all ids from one flat table.

The vocabulary file is read by the driver and broadcast: a few megabytes, whatever the data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.llm import flat
from cotaflow.session import ship_package

#: Fixed value: how byte-level vocabularies cut texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces a task process remembers, by number and by characters; then it starts anew.
REMEMBERED, REMEMBERED_CHARS = 300_000, 6_000_000
_SHIFT = np.int64(20)
_NEVER = np.int64(2**40)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Tables of a vocabulary file of the tokenizers library (byte-level BPE without normalizer or prefix space)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocabulary, letters = spec["model"]["vocab"], byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocabulary[m[i]] for m in merges], np.int64) for i in (0, 1))
        whole = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        keys = (left << _SHIFT) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.whole = keys[order], order.astype(np.int64), whole[order]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocabulary[letter]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spelled = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if t not in special}
        spelled |= {i: t.encode() for t, i in special.items()}
        spelled = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.known, self.chars = dict(self.special), 0

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        done_symbols, done_pieces = [], []
        while len(symbols):
            keys = np.full(len(symbols), -1, np.int64)
            inside = piece[:-1] == piece[1:]
            keys[:-1][inside] = ((symbols[:-1] << _SHIFT) | symbols[1:])[inside]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where(self.keys[at] == keys, self.ranks[at], _NEVER)
            begin = np.flatnonzero(np.concatenate(([True], ~inside)))
            least = np.minimum.reduceat(rank, begin)
            least = np.repeat(least, np.diff(np.append(begin, len(symbols))))
            chosen = np.flatnonzero((rank == least) & (least < _NEVER))
            # In a run of overlapping places (x x x) every other one from the left is merged.
            fresh = np.concatenate(([True], np.diff(chosen) > 1)) if len(chosen) else np.zeros(0, bool)
            run = np.flatnonzero(fresh)
            place = np.arange(len(chosen)) - np.repeat(run, np.diff(np.append(run, len(chosen))))
            chosen = chosen[place % 2 == 0]
            symbols[chosen] = self.whole[at[chosen]]
            stay = np.ones(len(symbols), bool)
            stay[chosen + 1] = False
            over = least == _NEVER
            done_symbols.append(symbols[over])
            done_pieces.append(piece[over])
            stay &= ~over
            symbols, piece = symbols[stay], piece[stay]
        owner = np.concatenate(done_pieces)
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate(done_symbols)[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces))) * 4
        return [ids[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)]

    def _chunks(self, text: str) -> list[str]:
        """Parts of a text that can be cut into pieces one by one: a space between two words begins a new part."""
        parts = text.split(" ")
        for part in parts:
            if not part or part[0].isspace() or part[-1].isspace():
                return self.pieces(text)
        return [parts[0], *[" " + x for x in parts[1:]]]

    def _learn(self, chunks: set[str]) -> None:
        cut = {chunk: self.pieces(chunk) for chunk in chunks}
        new = list({p for pieces in cut.values() for p in pieces if p not in self.known})
        if new:
            self.known.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        self.known.update((chunk, b"".join(map(self.known.__getitem__, pieces))) for chunk, pieces in cut.items() if len(pieces) != 1)
        self.chars += sum(map(len, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the tokenizers library gives them without added special tokens."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        cut = [self.cut_special.split(t) if self.cut_special else [t] for t in texts]
        parts = [[chunk for seg in segs for chunk in ([seg] if seg in self.special else self._chunks(seg) if seg else [])] for segs in cut]
        new = {chunk for own in parts for chunk in set(own).difference(self.known)}
        if new:
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, own)) for own in parts]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(total)]


_tables: dict[bytes, ByteBPE] = {}


def _table(content: bytes) -> ByteBPE:
    """The tables of a vocabulary, built once in a task process."""
    if content not in _tables:
        _tables[content] = ByteBPE(content)
    return _tables[content]


def encode_decode(
    documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row of ``documents``.

    ``vocabulary`` is the path, on the driver, of a tokenizers file with a byte-level BPE model.  ``ids`` are
    what that library's ``encode(text, add_special_tokens=False)`` gives without truncation and padding, as
    little-endian unsigned 32-bit integers; the spelling of a special token in a text is that token.
    ``decoded`` is its ``decode(ids, skip_special_tokens=False)``.  Null counts as empty and has no ids; rows
    that repeat or share an id are encoded one by one; no rows give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(content.value)
        for batch in flat.slices(batches, "text", 2 << 20):
            ids = table.encode([t or "" for t in batch.column("text").to_pylist()])
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            numbers = np.frombuffer(b"".join(ids), "<u4")
            raw = table.decode(numbers).tobytes()
            ends = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(ids)), counts), table.lengths[numbers], len(ids)))))
            ends = ends.astype(np.int64).tolist()
            decoded = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    chosen = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
