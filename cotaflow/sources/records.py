"""Records of delimited text, of which a quoted field may go over several lines.

A file is read in pieces, by as many tasks, and whether a piece begins inside a quoted field is only known from
all pieces before it.  So each piece is scanned under both assumptions and told in one row: the state it ends in for either
beginning, its lines, and where the record begins that is open at its end.  These rows, one for each piece,
are put in order, and running over them gives every piece its real beginning.  The lines of records of several
lines are then put together by the place where their record begins; all other lines go on as they are.

Quotes count where a field begins with one, after blanks; a quote inside such a field ends it when a separator or
the end of the line follows, and two quotes stay inside.  A field that is not closed to the end of its file
is no quoted field: each of its lines is a record of its own, so one stray quote does not take in the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotaflow.session import ship_package
from cotaflow.sources.scratch import staged


@lru_cache
def _patterns(sep: str, quote: str) -> tuple[re.Pattern, re.Pattern]:
    s, q = re.escape(sep), re.escape(quote)
    return re.compile(rf"(?:^﻿?|{s})[ \t]*{q}"), re.compile(rf"{q}{q}|{q}(?=[ \t]*(?:{s}|\r?$))|{q}")


def ends_inside(line: str, inside: bool, sep: str = ";", quote: str = '"') -> bool:
    """Whether a quoted field is open at the end of a line, given whether one is at its beginning."""
    opening, ending = _patterns(sep, quote)
    at = 0
    while True:
        if inside:
            found = ending.search(line, at)
            if found is None:
                return True
            at = found.end()
            inside = found.end() - found.start() == 2 * len(quote)
        else:
            found = opening.search(line, at)
            if found is None:
                return False
            at, inside = found.end(), True


class Scan:
    """The state after each line so far, and the line at which the open record begins, for either beginning."""

    def __init__(self, sep: str, quote: str):
        self.sep, self.quote = sep, quote
        self.lines = 0
        self.inside = [0, 1]
        self.open = [-1, -1]  # -1: before the first line

    def take(self, lines: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each line, for either beginning: inside before, inside after, first line of its record."""
        own = np.arange(self.lines, self.lines + len(lines))
        quoted = np.flatnonzero(pc.match_substring(lines, self.quote).to_numpy(zero_copy_only=False))
        texts = lines.take(pa.array(quoted)).to_pylist()
        out = []
        for h in (0, 1):
            before, after = np.empty(len(lines), np.int8), np.empty(len(lines), np.int8)
            first = np.empty(len(lines), np.int64)
            inside, opened, at = self.inside[h], self.open[h], 0
            for k, text in zip(quoted.tolist(), texts, strict=True):
                before[at : k + 1], after[at:k] = inside, inside
                first[at : k + 1] = opened if inside else own[at : k + 1]
                now = int(ends_inside(text, bool(inside), self.sep, self.quote))
                opened = int(own[k]) if now and not inside else opened
                after[k] = inside = now
                at = k + 1
            before[at:], after[at:] = inside, inside
            first[at:] = opened if inside else own[at:]
            self.inside[h], self.open[h] = inside, opened
            out.append((before, after, first))
        self.lines += len(lines)
        return out


def _pieces(batches: Iterator[pa.RecordBatch], sep: str, quote: str) -> Iterator[tuple[str, int, Scan, pa.Array, bool]]:
    """Runs of lines of one piece of a file with the scan of that piece; whether the run begins a new one."""
    current, scan = None, None
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        i = 0
        while i < batch.num_rows:
            piece = (files[i], int(blocks[i]))
            j = i + 1
            while j < batch.num_rows and blocks[j] == piece[1] and files[j] == piece[0]:
                j += 1
            new = piece != current
            if new:
                current, scan = piece, Scan(sep, quote)
            yield *piece, scan, batch.column("line").slice(i, j - i), new
            i = j


def _told(sep: str, quote: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each piece."""
        last = None

        def row() -> pa.RecordBatch:
            file, block, scan = last
            values = [file, block, scan.lines, *scan.inside, *scan.open]
            kinds = [pa.string(), *[pa.int64()] * 6]
            names = ["file", "block", "lines", "end0", "end1", "open0", "open1"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for file, block, scan, lines, new in _pieces(batches, sep, quote):
            if new and last:
                yield row()
            scan.take(lines)
            last = (file, block, scan)
        if last:
            yield row()

    return run


_STATES = ["before0", "after0", "first0", "before1", "after1", "first1"]


def _scanned(sep: str, quote: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every line with its number in its piece and its states for either beginning."""
        for file, block, scan, lines, _ in _pieces(batches, sep, quote):
            number = np.arange(scan.lines, scan.lines + len(lines))
            states = [pa.array(x.astype(np.int64)) for h in scan.take(lines) for x in h]
            columns = [pa.repeat(file, len(lines)), pa.repeat(pa.scalar(block, pa.int64()), len(lines)), pa.array(number), lines, *states]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "number", "line", *_STATES])

    return run


def _beginnings(told: DataFrame) -> DataFrame:
    """(file, block, entry, from_block, from_line, offset, torn_block, torn_line): how each piece really begins.

    A piece's end as a function of its beginning is constant, the beginning itself, or its opposite, so the state
    before a piece is what the last constant one before it left, turned over for each opposite one since.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = (F.col("end0") > F.col("end1")).cast("long")
    told = told.withColumn("turns", F.sum(turns).over(so_far))
    anchor = F.last(F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").alias("state"), "turns")), ignorenulls=True).over(before)
    told = told.withColumns({"anchor": anchor, "own": turns})
    state = F.coalesce("anchor.state", F.lit(0)) + F.col("turns") - F.col("own") - F.coalesce("anchor.turns", F.lit(0))
    told = told.withColumn("entry", F.pmod(state, F.lit(2)))
    first = F.col("entry") == 0
    told = told.withColumns({"end": F.when(first, F.col("end0")).otherwise(F.col("end1")), "opened": F.when(first, F.col("open0")).otherwise(F.col("open1"))})
    opens = F.when((F.col("end") == 1) & (F.col("opened") >= 0), F.struct("block", F.col("opened").alias("line")))
    told = told.withColumns({
        "from": F.last(opens, ignorenulls=True).over(before),
        "offset": F.coalesce(F.sum("lines").over(before), F.lit(0)),
        "state_at_end": F.last("end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "torn": F.last(opens, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    torn = F.when(F.col("state_at_end") == 1, F.col("torn"))
    return told.select(
        "file", "block", "entry", "offset", F.col("from.block").alias("from_block"), F.col("from.line").alias("from_line"),
        torn["block"].alias("torn_block"), torn["line"].alias("torn_line"),
    )


def records(lines: DataFrame, sep: str = ";", quote: str = '"') -> DataFrame:
    """(file, line_number, record) of ``lines`` (file, block, line), which a scan of text files hands over in order.

    ``block`` is where in the file the piece begins that a line was read in, as the scan tells it; lines of a
    piece must follow each other.  Line ends of Windows inside a field stay, at the end of a record they go.
    ``line_number`` is that of the record's first line, from 0; lines of white space between records are left out.
    """
    ship_package(lines.sparkSession)
    told = "file string, block long, lines long, end0 long, end1 long, open0 long, open1 long"
    begins = staged(_beginnings(lines.mapInArrow(_told(sep, quote), told)), "line-pieces")
    scanned = "file string, block long, number long, line string, " + ", ".join(f"{c} long" for c in _STATES)
    placed = lines.mapInArrow(_scanned(sep, quote), scanned).join(begins, ["file", "block"])
    outside = F.col("entry") == 0
    before, after, first = (F.when(outside, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("before", "after", "first"))
    of_piece = first >= 0
    placed = placed.select(
        "file", (F.col("offset") + F.col("number")).alias("line_number"), F.col("line"),
        F.when(of_piece, F.col("block")).otherwise(F.col("from_block")).alias("of_block"),
        F.when(of_piece, first).otherwise(F.col("from_line")).alias("of_line"),
        ((before == 1) | (after == 1)).alias("part"), "torn_block", "torn_line",
    )
    torn = (F.col("of_block") == F.col("torn_block")) & (F.col("of_line") == F.col("torn_line"))
    part = F.col("part") & ~F.coalesce(torn, F.lit(False))
    whole = placed.where(~part).select("file", "line_number", F.col("line").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("line_number", "line")))
    joined = placed.where(part).groupBy("file", "of_block", "of_line").agg(F.min("line_number").alias("line_number"), pieces.alias("lines"))
    joined = joined.select("file", "line_number", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record"))
    found = whole.unionByName(joined)
    return found.withColumn("record", F.rtrim("record", F.lit("\r"))).where(F.trim("record") != "")


def stream_records(blocks: Iterable[list[str]], again, sep: str, quote: str) -> Iterator[list[str]]:
    """The records of one stream of lines, a block at a time; ``again()`` gives the stream once more.

    Only the lines of an open record are held back.  Where one is open at the end of a block, the stream is
    looked through once to its end, so that a field that is never closed is not held.
    """
    scan, waiting, torn, looked = Scan(sep, quote), [], None, False
    for lines in blocks:
        before, after, _ = scan.take(pa.array(lines, pa.string()))[0]
        begin = scan.lines - len(lines)
        if scan.inside[0] and not looked:
            whole = Scan(sep, quote)
            for block in again():
                whole.take(pa.array(block, pa.string()))
            torn, looked = (whole.open[0] if whole.inside[0] else None), True
        out = []
        for k, line in enumerate(lines):
            if torn is not None and begin + k >= torn:
                out += [*waiting, line]
                waiting = []
            elif after[k]:
                waiting.append(line)
            elif before[k]:
                out.append("\n".join([*waiting, line]))
                waiting = []
            else:
                out.append(line)
        if out := [x for x in (x.rstrip("\r") for x in out) if x.strip()]:
            yield out
    if waiting:
        yield [x.rstrip("\r") for x in waiting]
