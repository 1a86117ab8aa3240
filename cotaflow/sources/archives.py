"""Tables inside zip archives."""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotaflow.operators.prefix import running_total
from cotaflow.session import ship_package
from cotaflow.sources.delimited import parsed
from cotaflow.sources.files import header_of, locate
from cotaflow.sources.records import stream_records
from cotaflow.sources.scratch import staged

BLOCK_BYTES = 4 << 20
#: Compressed bytes of small members that one task reads.
TASK_BYTES = 16 << 20


def archive_members(
    spark: SparkSession, folder: str, archives: str = "*.zip", members: str = "*.csv", encoding: str = "utf-8"
) -> DataFrame:
    """``archive``, ``member``, ``header`` and compressed ``size`` of every matching file inside the matching archives.

    An archive without a matching file has a row without ``member``.  Only the directory of an archive
    and the first lines of each member are read.
    """
    ship_package(spark)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", archives).load(folder).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = locate(path)
                rows = []
                with system.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
                    for member in archive.namelist():
                        if fnmatch.fnmatch(member, members):
                            with archive.open(member) as stream:
                                size = archive.getinfo(member).compress_size
                                rows.append((path, member, header_of(stream, encoding), size))
                *texts, sizes = zip(*(rows or [(path, None, None, None)]))
                columns = [*(pa.array(c, pa.string()) for c in texts), pa.array(sizes, pa.int64())]
                yield pa.record_batch(columns, ["archive", "member", "header", "size"])

    return paths.mapInArrow(read, "archive string, member string, header string, size long")


def dealt(members: DataFrame) -> tuple[DataFrame, int]:
    """``members`` with the task each is for, and the number of tasks.

    A member is one piece of work, so a task holds as much as the largest member, or TASK_BYTES if that is
    more.  Members of more than half of that have a task each; the others are lined up and cut into tasks by
    their running total, so none has more than one and a half times it.
    """
    whole = max(TASK_BYTES, members.agg(F.max("size")).first()[0] or 0)
    share = F.when(F.col("size") * 2 > whole, F.lit(whole)).otherwise(F.col("size"))
    order = members.withColumns({"__share": share, "__minus": -F.col("size")})
    lined = running_total(order, "__share", ["__minus", "archive", "member"], "__end")
    task = F.floor((F.col("__end") - F.col("__share")) / whole).cast("int")
    total = order.agg(F.sum("__share")).first()[0] or 0
    return lined.withColumn("task", task).drop("__end", "__share", "__minus"), int(total // whole) + 1


def member_lines(members: DataFrame, encoding: str = "utf-8", sep: str = ";", quote: str = "") -> DataFrame:
    """The records after the header of each member, as ``archive``, ``member``, ``header``, ``line``.

    A compressed member can only be read from its start, so one member is one piece of work; it
    streams through its task in blocks.  Members are dealt to tasks by size.
    With ``quote`` a record may go over several lines (``sources.records``).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = locate(row["archive"])
                with system.open_input_file(name) as file, zipfile.ZipFile(file) as archive:

                    def blocks() -> Iterator[list[str]]:
                        with archive.open(row["member"]) as stream:
                            header_of(stream, encoding)
                            for lines in _blocks(stream):
                                yield [x.decode(encoding) for x in lines]

                    for lines in stream_records(blocks(), blocks, sep, quote or "\x00"):
                        of = [pa.repeat(row[c], len(lines)) for c in ("archive", "member", "header")]
                        yield pa.record_batch([*of, pa.array(lines, pa.string())], ["archive", "member", "header", "line"])

    members, tasks = dealt(members)
    spread = members.select("archive", "member", "header", "task").repartitionById(tasks, "task")
    return spread.mapInArrow(read, "archive string, member string, header string, line string")


def _blocks(stream) -> Iterator[list[bytes]]:
    """The lines of a byte stream, a block at a time."""
    rest = b""
    while block := stream.read(BLOCK_BYTES):
        *lines, rest = (rest + block).split(b"\n")
        if lines:
            yield lines
    if rest:
        yield [rest]


def read_archives(
    spark: SparkSession,
    folder: str,
    types: dict[str, str],
    archives: str = "*.zip",
    members: str = "*.csv",
    sep: str = ";",
    quote: str = '"',
    encoding: str = "utf-8",
    problems: str | None = None,
) -> DataFrame:
    """All delimited members of all archives as one table, columns matched by name, absent ones NULL.

    Every archive must have a matching member; one without is an error, not an empty table.  Unpacking is
    the only Python step; the lines are parsed by Spark's own CSV reader, each under its own header.
    ``problems`` is as for ``read_delimited``.
    """
    found = staged(archive_members(spark, folder, archives, members, encoding), "members")
    if empty := found.where("member IS NULL").first():
        raise ValueError(f"no member {members} in {empty.archive}")
    found = found.where("header <> ''")
    headers = list(found.select("header").distinct().orderBy("header").toLocalIterator())
    if not headers:
        raise FileNotFoundError(f"no archive {archives} with a member that has a header in {folder}")
    return parsed(member_lines(found, encoding, sep, quote), [c.header for c in headers], types, sep, quote, problems)
