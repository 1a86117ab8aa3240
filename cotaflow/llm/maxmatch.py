"""Token counts of greedy longest-match word pieces, by a linear automaton.

The vocabulary is a trie with failure links.  Where a text leaves the trie, the link says which state remains
once the longest pieces are taken off, and a precomputed number how many pieces that takes, so pieces are
counted without being built and each byte is read once.  The distinct words of a slice of texts run through the
automaton in step, as numpy arrays: a step reads one byte of every word that is long enough.

A word is a run of anything but ASCII white space, with the vocabulary's word mark in front.  The vocabulary
goes to the tasks as a broadcast of its file: a few megabytes, whatever the data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.llm import flat
from cotaflow.llm.bpe import byte_letters
from cotaflow.session import ship_package

#: A word that can't be cut into pieces is one unknown piece.
UNKNOWN = 1


#: From this byte on, if so few words are as long, each is walked by itself: a step of all words costs more then.
LONG, FEW = 64, 32


class MaxMatch:
    """Trie of pieces (bytes) with failure links and popped-piece counts; state 0 is the root."""

    def __init__(self, pieces: list[bytes], mark: bytes = b" "):
        edges: dict[int, int] = {}
        parent, symbol, is_piece = [-1], [0], [False]
        for piece in pieces:
            state = 0
            for byte in piece:
                key = state << 8 | byte
                after = edges.get(key)
                if after is None:
                    after = edges[key] = len(parent)
                    parent.append(state)
                    symbol.append(byte)
                    is_piece.append(False)
                state = after
            is_piece[state] = state > 0
        n = len(parent)
        depth = np.zeros(n, np.int64)
        for state in range(1, n):
            depth[state] = depth[parent[state]] + 1
        fail, popped = [-1] * n, [0] * n
        for state in np.argsort(depth, kind="stable")[1:].tolist():
            if is_piece[state]:
                fail[state], popped[state] = 0, 1
                continue
            at, count = fail[parent[state]], popped[parent[state]]
            while at >= 0 and (at << 8 | symbol[state]) not in edges:
                count += popped[at]
                at = fail[at]
            if at >= 0:
                fail[state], popped[state] = edges[at << 8 | symbol[state]], count
        keys = np.array(sorted(edges), np.int64)
        self.keys, self.after = keys, np.array([edges[k] for k in keys.tolist()], np.int64)
        self.fail, self.popped, self.mark = np.array(fail), np.array(popped), mark
        self.edges, self.fail_of, self.popped_of = edges, fail, popped

    def _step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state after each symbol, -1 where the trie has no edge."""
        wanted = states << 8 | symbols
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.after[at], -1)

    def counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pieces of each word ``data[start : start + size]``, with the mark in front."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        out = np.zeros(len(starts), np.int64)
        states = np.zeros(len(starts), np.int64)
        longest, falling = int(sizes[0]) if len(sizes) else 0, -sizes
        for place in range(-len(self.mark), longest):
            n = len(sizes) if place < 0 else int(np.searchsorted(falling, -place, "left"))  # words longer than that
            if place >= LONG and n <= FEW:
                for i in range(n):
                    rest = data[starts[i] + place : starts[i] + sizes[i]].tobytes()
                    states[i], out[i] = self._walk(rest, int(states[i]), int(out[i]))
                break
            symbols = np.full(n, self.mark[place], np.int64) if place < 0 else data[starts[:n] + place].astype(np.int64)
            live = np.flatnonzero(states[:n] >= 0)
            while len(live):
                after = self._step(states[live], symbols[live])
                moved = after >= 0
                states[live[moved]] = after[moved]
                live = self._pop(live[~moved], states, out)
        live = np.flatnonzero(states > 0)
        while len(live):
            live = self._pop(live, states, out)
            live = live[states[live] > 0]
        out[states < 0] = UNKNOWN
        result = np.empty_like(out)
        result[order] = out
        return result

    def _walk(self, rest: bytes, state: int, count: int) -> tuple[int, int]:
        """State and pieces after the rest of one word, byte by byte."""
        edges, fail, popped = self.edges, self.fail_of, self.popped_of
        for byte in rest:
            if state < 0:
                break
            after = edges.get(state << 8 | byte)
            while after is None:
                count += popped[state]
                state = fail[state]
                if state < 0:
                    break
                after = edges.get(state << 8 | byte)
            else:
                state = after
        return state, count

    def _pop(self, live: np.ndarray, states: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Follow the failure links of these words; those without one are lost, the others are returned."""
        out[live] += self.popped[states[live]]
        states[live] = self.fail[states[live]]
        return live[states[live] >= 0]


def vocabulary_pieces(content: bytes) -> list[bytes]:
    """The pieces, as bytes, of a byte-level vocabulary file."""
    letters = byte_letters()
    spec = json.loads(content)
    special = {t["content"] for t in spec["added_tokens"]}
    return sorted(bytes(letters[c] for c in token) for token in spec["model"]["vocab"] if token not in special)


_machines: dict[bytes, MaxMatch] = {}


def _machine(content: bytes) -> MaxMatch:
    if content not in _machines:
        _machines[content] = MaxMatch(vocabulary_pieces(content))
    return _machines[content]


def token_counts(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_pieces, longest_word) of each row of ``documents``.

    ``vocabulary`` is the path, on the driver, of a byte-level vocabulary file, whose pieces that begin a word
    begin with a space.  ``n_pieces`` adds up, over all words, the pieces of the greedy longest match; a word
    with a byte that no piece has counts as one.  ``longest_word`` is the most pieces that a word has.  Null
    and empty texts have no words; rows that repeat or share an id are counted one by one; no rows give no
    rows; other columns are ignored.
    """
    spark = documents.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(content.value)
        for batch in flat.slices(batches, "text"):
            words = flat.Words(batch.column("text"))
            _, one, which = np.unique(words.hashes, return_index=True, return_inverse=True)
            sizes = words.ends - words.starts
            pieces = machine.counts(words.data, words.starts[one], sizes[one])[which]
            total = np.concatenate(([0], np.cumsum(pieces)))
            counts = words.counts()
            most = np.zeros(batch.num_rows, np.int64)
            full = np.flatnonzero(counts)
            if len(full):
                most[full] = np.maximum.reduceat(pieces, words.first[full])
            sums = total[words.first[1:]] - total[words.first[:-1]]
            columns = [batch.column("id"), *(pa.array(x.astype(np.int64)) for x in (counts, sums, most))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_pieces", "longest_word"])

    chosen = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, n_pieces long, longest_word long")
