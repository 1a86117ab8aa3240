"""Delimited text files of several header vintages as one table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotaflow.session import ship_package
from cotaflow.sources.files import first_line
from cotaflow.sources.records import records
from cotaflow.sources.scratch import staged

# Bytes 0x80 to 0x9F are printable characters in windows-1252 and control characters in ISO-8859-1;
# all other bytes mean the same in both.
_CODES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
LATIN1_CONTROLS = "".join(map(chr, _CODES))
CP1252_PRINTABLE = bytes(_CODES).decode("cp1252")


def column_names(header: str, sep: str = ";") -> list[str]:
    return [name.strip().strip('"') for name in header.split(sep)]


def schema_for(header: str, types: dict[str, str], sep: str = ";") -> str:
    """Schema of a header line.  Columns without a known type stay text: ids must not become numbers."""
    return ", ".join(f"`{name}` {types.get(name, 'string')}" for name in column_names(header, sep))


def csv_options(sep: str, quote: str) -> dict[str, str]:
    """Fields are trimmed, an empty field and the text NA are missing, and a backslash is just a backslash."""
    trimmed = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return {"sep": sep, "quote": quote, "escape": "", "nullValue": "NA", "emptyValue": "NA", **trimmed}


# A separator no text holds, so that the reader hands over whole lines in any encoding.
WHOLE_LINES = {"sep": "\uffff", "quote": "", "escape": "", "header": "false"}


def file_headers(spark: SparkSession, folder: str, pattern: str = "*.csv", encoding: str = "utf-8") -> DataFrame:
    """``file`` and ``header`` of every matching file; the tasks open each file for its first lines only."""
    ship_package(spark)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    paths = paths.select("path", F.col("_metadata.file_path").alias("file"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = [first_line(path.as_py(), encoding) for path in batch.column("path")]
            yield pa.record_batch([batch.column("file"), pa.array(headers, pa.string())], ["file", "header"])

    return paths.mapInArrow(read, "file string, header string")


def parsed(
    lines: DataFrame, headers: list[str], types: dict[str, str], sep: str, quote: str, problems: str | None = None
) -> DataFrame:
    """``lines`` (``header``, ``line``) as columns matched by name, absent ones NULL; other columns stay.

    Each line is parsed once, under the schema of its own header.  ``problems`` names a column for the
    whole line where a field does not fit its type or there are too many or too few.
    """
    names = list(dict.fromkeys(name for header in headers for name in column_names(header, sep)))
    kinds = {name: types.get(name, "string") for name in names} | ({problems: "string"} if problems else {})
    options = csv_options(sep, quote) | ({"columnNameOfCorruptRecord": problems} if problems else {})
    row = None
    for header in headers:
        schema = schema_for(header, types, sep) + (f", `{problems}` string" if problems else "")
        own = {*column_names(header, sep), problems}
        found = F.from_csv("line", schema, options)
        common = F.struct(*[(found[n] if n in own else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()])
        # The header line itself is no row, even where a later filter looks at fields first.
        this = (F.col("header") == F.lit(header)) & (F.col("line") != F.lit(header))
        row = F.when(this, common) if row is None else row.when(this, common)
    kept = [c for c in lines.columns if c not in ("header", "line")]
    return lines.select(*kept, row.alias("__row")).select(*kept, "__row.*")


def read_delimited(
    spark: SparkSession,
    folder: str,
    types: dict[str, str],
    pattern: str = "*.csv",
    sep: str = ";",
    quote: str = '"',
    encoding: str = "utf-8",
    problems: str | None = None,
    line_number: str | None = None,
) -> DataFrame:
    """All matching files as one table, columns matched by name, absent ones NULL.

    Every record is parsed under the header of its own file; reading a mixed folder under one schema would
    put values into the wrong columns.  A file's header is its first line that is not blank; files of
    blank lines only are empty.  The driver sees the distinct headers, never the list of files.
    ``encoding`` may be ``windows-1252``.  ``problems`` names a column
    that holds the whole record where a field does not fit its type, or there are too many or too few.

    Quoted fields may hold line breaks; files are read in pieces all the same (``sources.records``).  Where no
    file has a quote, each line is a record, as with ``quote=""``, which switches quoting off.  ``line_number``
    names a column for the number of a record's first line in its file, from 1.
    """
    latin = encoding.lower() in ("windows-1252", "cp1252")
    found = staged(file_headers(spark, folder, pattern, "cp1252" if latin else encoding).where("header <> ''"), "headers")
    headers = [r.header for r in found.select("header").distinct().orderBy("header").toLocalIterator()]
    if not headers:
        raise FileNotFoundError(f"no file with a header matches {pattern} in {folder}")
    numbered = line_number is not None
    raw = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(folder)
    if numbered or (quote and not raw.where(F.col("value").contains(quote)).isEmpty()):
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        text = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if latin else F.col("value")
        # Without quoting no line holds what is looked for, so each is a record.
        found_records = records(raw.select(*place, text.alias("line")), sep, quote or "\x00")
        number = [(F.col("line_number") + 1).alias(line_number)] if numbered else []
        lines = found_records.select("file", F.col("record").alias("line"), *number)
    else:
        lines = spark.read.schema("line string").option("pathGlobFilter", pattern).options(**WHOLE_LINES)
        lines = lines.option("encoding", "ISO-8859-1" if latin else encoding).csv(folder)
        lines = lines.select("line", F.col("_metadata.file_path").alias("file"))
    text = cp1252_text(F.col("line")) if latin else F.col("line")
    lines = lines.withColumn("line", F.ltrim(text, F.lit("\ufeff")))
    lines = lines.join(found, "file").where((F.col("line") != F.col("header")) & (F.trim("line") != "")).drop("file")
    return parsed(lines, headers, types, sep, quote, problems)


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """Stack tables by column name, filling absent columns with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cp1252_text(x: Column) -> Column:
    """Text that was decoded as ISO-8859-1 although it is windows-1252."""
    return F.when(x.rlike("[\\x80-\\x9f]"), F.translate(x, LATIN1_CONTROLS, CP1252_PRINTABLE)).otherwise(x)
