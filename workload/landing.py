"""Landing folders made from the test tables, for the queries that read files."""

from __future__ import annotations

import posixpath
import shutil
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotaflow.session import ship_package
from cotaflow.sources.delimited import CP1252_PRINTABLE, LATIN1_CONTROLS
from cotaflow.sources.files import locate


def write_csv(df: DataFrame, folder: str, **options: str) -> None:
    df.write.options(**{"sep": ";", "header": "true", **options}).csv(folder)


def write_cp1252(df: DataFrame, folder: str) -> None:
    """Text columns in windows-1252 bytes, without quoting."""
    names = [n for n, kind in df.dtypes if kind == "string"]
    coded = df.withColumns({n: F.translate(n, CP1252_PRINTABLE, LATIN1_CONTROLS) for n in names})
    write_csv(coded, folder, encoding="ISO-8859-1", quote="", emptyValue="")


def zip_files(spark: SparkSession, folder: str, target: str) -> None:
    """One archive per CSV file of ``folder``, packed by the tasks.

    An archive gets its name only when complete, so a task that is run again does no harm.
    """
    ship_package(spark)
    system, plain = locate(target)
    system.create_dir(plain, recursive=True)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, name = locate(path)
                out, goal = locate(target)
                member = posixpath.basename(name)
                started = f"{goal}/.{uuid.uuid4().hex}"
                with out.open_output_stream(started) as raw:
                    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
                        with archive.open(member, "w") as entry, source.open_input_stream(name) as text:
                            shutil.copyfileobj(text, entry, 1 << 20)
                out.move(started, f"{goal}/{member.removesuffix('.csv')}.zip")
            yield batch

    paths.mapInArrow(pack, "path string").write.format("noop").mode("overwrite").save()


def write_lines(lines: DataFrame, header: str, folder: str, blank_lines: int = 0) -> None:
    """Text files of the column ``line``, each below ``blank_lines`` empty lines and a header."""
    ship_package(lines.sparkSession)
    system, plain = locate(folder)
    system.create_dir(plain, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, goal = locate(folder)
        name = f"{goal}/{uuid.uuid4().hex}"
        rows = 0
        with out.open_output_stream(f"{name}.part") as target:
            target.write(b"\n" * blank_lines + header.encode() + b"\n")
            for batch in batches:
                for line in batch.column("line").to_pylist():
                    target.write(line.encode() + b"\n")
                    rows += 1
        if rows:
            out.move(f"{name}.part", f"{name}.csv")
        else:
            out.delete_file(f"{name}.part")
        yield pa.record_batch([pa.array([rows])], ["rows"])

    lines.mapInArrow(write, "rows long").write.format("noop").mode("overwrite").save()
