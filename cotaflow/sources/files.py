"""Opening files from inside a task, wherever the cluster keeps them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a path as Spark reports it, which is not percent-encoded."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def any_match(spark: SparkSession, folder: str, pattern: str) -> bool:
    """Whether a folder holds a file of that name pattern."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return not found.select("path").isEmpty()


def first_line(path: str, encoding: str) -> str:
    """The first line of a text file that is not blank, without its line end or byte-order mark."""
    system, name = locate(path)
    with system.open_input_stream(name) as stream:
        return header_of(_lines(stream), encoding)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(1 << 16):
        *lines, rest = (rest + block).split(b"\n")
        yield from lines
    yield rest


def header_of(lines: Iterable[bytes], encoding: str) -> str:
    """The first of the lines that is not blank; empty if there is none.  Lines are taken up to that one."""
    for line in lines:
        if text := line.decode(encoding).lstrip("﻿").strip("\r\n"):
            if text.strip():
                return text
    return ""
