"""Substring deduplication: words of long passages that occur elsewhere are removed, by De Bruijn compaction.

Runs of ten words are k-mers.  Of each window of 35 words the k-mer of least hash is an anchor, so two equal
windows hold the same anchor at the same place, and only one k-mer in thirteen has to be moved.  Anchors are
the nodes of a De Bruijn graph; an edge is the run of words from one anchor of a text through the next.  A
node is straight when it occurs more than once, always behind the same edge and before the same edge.  A path
through straight nodes compacts to one span: wherever one of its nodes occurs, all of it occurs, so each window
inside the span is repeated, and none of them is looked up.  Windows that hold a repeated anchor and a node
that is not straight (at the ends of a passage, or where texts part) are verified at their source coordinates,
by a count of 96-bit hashes of the whole window.  Equal windows are on the same side of this rule, since they
agree on their least anchor and so, through straight nodes, on the path around it.

What is shuffled: anchors twice (for the nodes, and to bring the verdicts back), texts twice, and the windows
to verify.  All groupings are sums; joins on an anchor or a window have one row a key on one side, so a
passage that a third of the texts share is split by the adaptive planner.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotaflow.llm import flat
from cotaflow.session import ship_package
from cotaflow.sources.scratch import Staging, staged

WINDOW = 35
KMER = 10
#: k-mers that begin in a window and end in it.
SPAN = WINDOW - KMER + 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Anchors:
    """Anchors of a batch: positions among all its words, node and edge hashes, and what windows are told by."""

    def __init__(self, texts: pa.Array):
        self.words = flat.Words(texts)
        hashes = self.words.hashes
        self.kmers = flat.rolling(hashes, KMER)
        self.least = flat.sliding(self.kmers, SPAN, np.minimum)
        self.inside = self.words.grams_of(WINDOW)[: len(self.least)]
        self.least[~self.inside] = 0  # windows over the end of a text have none
        if len(self.least):
            none = np.zeros(SPAN - 1, np.uint64)
            highest = flat.sliding(np.concatenate((none, self.least, none)), SPAN, np.maximum)
            self.at = np.flatnonzero((highest == self.kmers) & (highest > 0))
        else:
            self.at = np.zeros(0, np.int64)
        self.document = np.searchsorted(self.words.first, self.at, "right") - 1

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the edge into and out of each anchor, 0 at the ends of a text."""
        into = np.zeros(len(self.at), np.uint64)
        out = np.zeros(len(self.at), np.uint64)
        if len(self.at) > 1:
            second = flat.rolling(self.words.hashes, KMER, second=True)
            left, right = self.at[:-1], self.at[1:]
            joined = self.document[:-1] == self.document[1:]
            left, right = left[joined], right[joined]
            run = flat.mix((right - left).astype(np.uint64) + second[left])
            for step in (KMER, 2 * KMER):  # anchors lie at most SPAN apart
                run = flat.mix(run + second[np.minimum(left + step, right)])
            run = flat.mix(run + second[right]) | np.uint64(1)
            out[:-1][joined] = run
            into[1:][joined] = run
        return into, out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in flat.slices(batches, "text"):
        anchors = Anchors(batch.column("text"))
        into, out = anchors.edges()
        yield pa.RecordBatch.from_arrays(
            [flat.signed(anchors.kmers[anchors.at]), flat.signed(into), flat.signed(out)], names=["node", "into", "out"]
        )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in flat.slices(batches, "text"):
        anchors = Anchors(batch.column("text"))
        rows = pa.array(anchors.document)
        place = anchors.at - anchors.words.first[anchors.document]
        yield pa.RecordBatch.from_arrays(
            [flat.signed(anchors.kmers[anchors.at]), batch.column("key").take(rows), batch.column("version").take(rows), pa.array(place)],
            names=["node", "key", "version", "place"],
        )


def _flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a list column, and the row of each; null lists have none."""
    lengths = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), lengths)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows (length, from place on) and single windows to verify (their hashes, length 0)."""
    for batch in flat.slices(batches, "text"):
        codes, rows = _flat_lists(batch.column("codes"))
        if not len(codes):
            continue
        anchors = Anchors(batch.column("text"))
        words = anchors.words
        at = words.first[rows] + (codes >> 1)
        repeated = np.zeros(len(anchors.kmers), bool)
        repeated[at] = True
        crooked = np.zeros(len(anchors.kmers) + 1, np.int64)
        crooked[anchors.at + 1] = 1
        crooked[at[(codes & 1) == 1] + 1] = 0
        crooked = np.cumsum(crooked)
        size = len(anchors.least)
        known = np.where(repeated, anchors.kmers, np.uint64(2**64 - 1))
        candidate = anchors.inside & (flat.sliding(known, SPAN, np.minimum) == anchors.least)
        straight = candidate & (crooked[SPAN : SPAN + size] == crooked[:size])
        document = words.document()[:size]

        # Runs of neighbouring straight windows of one text.
        ones = np.flatnonzero(straight)
        begins = np.ones(len(ones), bool)
        begins[1:] = (np.diff(ones) > 1) | (np.diff(document[ones]) > 0)
        start = ones[begins]
        length = np.diff(np.append(np.flatnonzero(begins), len(ones)))

        verify = np.flatnonzero(candidate & ~straight)
        first = flat.rolling(words.hashes, WINDOW)[verify] if len(verify) else np.zeros(0, np.uint64)
        second = flat.rolling(words.hashes, WINDOW, second=True)[verify] if len(verify) else np.zeros(0, np.uint64)
        second = (second >> np.uint64(32)).astype(np.uint32).view(np.int32)
        both = np.concatenate((start, verify))
        owner = pa.array(document[both])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key").take(owner),
                batch.column("version").take(owner),
                pa.array(both - words.first[document[both]]),
                pa.array(np.concatenate((length, np.zeros(len(verify), np.int64)))),
                flat.signed(np.concatenate((np.zeros(len(start), np.uint64), first))),
                pa.array(np.concatenate((np.zeros(len(start), np.int32), second))),
            ],
            names=["key", "version", "place", "length", "first", "second"],
        )


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """``text`` without the bytes from the first to the last word of each run of words that are ``gone``."""
    spans = [found.span() for found in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    kept, at = [], 0
    for first, after in edges.reshape(-1, 2):
        kept.append(text[at : spans[first][0]])
        at = spans[after - 1][1]
    return b"".join((*kept, text[at:]))


def _cut(batches: Iterator[pa.RecordBatch], as_written: bool) -> Iterator[pa.RecordBatch]:
    for batch in flat.slices(batches, "text"):
        texts = batch.column("text")
        data, offsets = flat.buffer(texts)
        raw = data.tobytes()
        null = texts.is_null().to_numpy(zero_copy_only=False)
        runs, rows = _flat_lists(batch.column("runs"))
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        counts, removed, kept = [], [], []
        for i in range(batch.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            words = text.split()
            counts.append(len(words))
            if bounds[i] < bounds[i + 1]:
                own = runs[bounds[i] : bounds[i + 1]]
                place, length = own >> 32, own & 0xFFFFFFFF
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, place, 1)
                np.add.at(change, place + length + WINDOW - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                text = _without(text, gone) if as_written else text
                words = [words[k] for k in np.flatnonzero(~gone)]
            removed.append(counts[-1] - len(words))
            if as_written:
                kept.append(None if null[i] else text)
            else:
                kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
                batch.column("row"),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_text", "row"],
        )


def _by_text(texts: DataFrame, lists: DataFrame) -> DataFrame:
    return texts.join(lists, ["key", "version"], "left")


def _gather(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """A list for each text: as long as the text at most."""
    return rows.groupBy("key", "version").agg(F.collect_set(value).alias(name))


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry=(), as_written: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, row) of each row of ``documents``; ``row`` holds the columns ``carry``.

    Words are runs of anything but ASCII white space, unchanged.  A word goes when a window of 35 words that
    covers it also starts anywhere else, in its own text included; windows are judged on the input, so no
    copy stays.  ``kept_text`` is what remains, joined by single spaces; with ``as_written`` it is the text itself,
    null where that is, without the bytes from the first to the last word of each run of words that go, and
    with all other bytes, white space too, as they were.  Null and empty texts have no words; texts of fewer
    than 35 words stay.  Repeated rows repeat each other's windows.  Rows may share an id, or
    have none.  No rows give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    ship_package(spark)
    # Rows of one id and text are one; 64 bits of both and 32 more of the text tell all others, without an id too.
    key = F.xxhash64(F.col(id_col).cast("long"), F.length(F.col(text_col)), F.col(text_col))
    columns = [key.alias("key"), F.hash(F.col(text_col)).alias("version"), F.col(text_col).alias("text")]
    texts = documents.select(*columns)
    with Staging(spark) as stage:
        nodes = texts.select("text").mapInArrow(_nodes, "node long, into long, out long")
        same = [(F.min(c) == F.max(c)) & (F.min(c) != 0) for c in ("into", "out")]
        repeated = nodes.groupBy("node").agg(F.count("*").alias("size"), (same[0] & same[1]).cast("long").alias("straight"))
        repeated = stage(repeated.where("size > 1").drop("size"), "repeated-nodes")
        places = texts.mapInArrow(_places, "node long, key long, version int, place long")
        judged = _gather(places.join(repeated, "node"), F.col("place") * 2 + F.col("straight"), "codes")
        windows = "key long, version int, place long, length long, first long, second int"
        windows = stage(_by_text(texts, judged).mapInArrow(_judged, windows), "windows")
        verify = windows.where("length = 0")
        twice = verify.groupBy("first", "second").agg(F.count("*").alias("size")).where("size > 1").drop("size")
        twice = stage(twice, "repeated-windows")
        verified = verify.join(twice, ["first", "second"]).withColumn("length", F.lit(1).cast("long"))
        runs = windows.where("length > 0").unionByName(verified).select("key", "version", "place", "length")
        runs = _gather(runs, F.shiftleft("place", 32) + F.col("length"), "runs")
        whole = documents.select(F.col(id_col).cast("long").alias("id"), *columns, flat.carried(carry))
        schema = flat.with_row(whole, "doc_id long, n_words long, n_removed long, kept_text string")
        return staged(_by_text(whole, runs).mapInArrow(partial(_cut, as_written=as_written), schema), "without-repeats")
