"""Records of several lines, however a file is cut into pieces."""

import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotaflow.sources import archives, delimited, records

from .conftest import rows


def plain(text, sep=";", quote='"'):
    """Records of a text, sign by sign: (number of the first line, record); an open field is none."""
    out, inside, begins, field_begins, line, at = [], False, 0, True, 0, 0
    first_line, open_at, k = 0, None, 0
    while k <= len(text):
        c = text[k] if k < len(text) else None
        if c is None or (c == "\n" and not inside):
            if c is None and inside:
                cut = text[begins:]
                out += [(first_line + i, x) for i, x in enumerate(cut.split("\n"))]
            else:
                out.append((first_line, text[begins:k]))
            begins, first_line, field_begins = k + 1, line + 1, True
            line += 1
        elif c == "\n":
            line += 1
        elif inside:
            if c == quote:
                rest = text[k + 1 :]
                if rest[:1] == quote:
                    k += 1
                else:
                    inside, field_begins = False, False
        elif c == sep:
            field_begins = True
        elif c == quote and field_begins:
            inside = True
        elif c not in " \t﻿":
            field_begins = False
        k += 1
    return [(n, r.rstrip("\r")) for n, r in out if r.strip(" \r")]


def some_text(seed, torn=False):
    r = random.Random(seed)

    def field():
        kind = r.random()
        if kind < 0.4:
            return r.choice(["", "12", "a b", 'in"ner', "5''"])
        inner = "".join(r.choice(["x", "y z", "\n", ";", '""', "\r\n", "\n\n"]) for _ in range(r.randint(0, 6)))
        return r.choice(["", " "]) + f'"{inner}"' + r.choice(["", " "])

    lines = [";".join(field() for _ in range(r.randint(1, 3))) for _ in range(60)]
    text = "\n".join(x + r.choice(["", "\r"]) for x in lines) + "\n"
    return text + ('open;"never closed\n1;2\n\n3;"q"\n' if torn else "")


@pytest.mark.parametrize("seed", range(4))
def test_records_of_files_cut_anywhere(spark, tmp_path, seed):
    texts = {f"{k}.csv": some_text(10 * seed + k, torn=k == 1) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = sorted((name, *x) for name, text in texts.items() for x in plain(text))
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("23", "157", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
            lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
            if size == "23":
                assert lines.rdd.getNumPartitions() > 20
            found = records.records(lines).select(F.element_at(F.split("file", "/"), -1), "line_number", "record")
            assert rows(found) == sorted(want, key=repr)
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
def test_records_of_a_stream(size):
    for seed in range(6):
        text = some_text(seed, torn=seed % 2 == 1)
        lines = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")

        def blocks():
            yield from (lines[i : i + size] for i in range(0, len(lines), size))  # noqa: B023

        found = [x for block in records.stream_records(blocks(), blocks, ";", '"') for x in block]
        assert found == [r for _, r in plain(text)]


def test_states_of_lines():
    for line, inside, want in [
        ('a;"b', False, True), ('a;"b";c', False, False), ('b";c', True, False), ('b"";c', True, True), ('x"y', False, False), ('x"y', True, False),
        (' "a', False, True), ('"a" ;"b', False, True), ('"a"b;"c', False, True), ("", True, True), ('"', True, False), ('""', False, False), ('"""', False, True),
    ]:
        assert records.ends_inside(line, inside) is want, line


def test_line_breaks_in_fields_of_files_and_archives(spark, tmp_path):
    text = 'n;t;x\n1;"first\nsecond; third";a\r\n\n2;plain;b\n3;"with ""quotes""\r\n\nand a gap";"c"\n'
    (tmp_path / "a.csv").write_bytes(text.encode())
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        out.writestr("a.csv", text)
    want = [(1, "first\nsecond; third", "a"), (2, "plain", "b"), (3, '"with ""quotes""\r\n\nand a gap"', "c")]
    assert rows(delimited.read_delimited(spark, str(tmp_path), {"n": "int"})) == want
    assert rows(archives.read_archives(spark, str(tmp_path), {"n": "int"}).select("n", "t", "x")) == want
    numbered = delimited.read_delimited(spark, str(tmp_path), {"n": "int"}, line_number="at")
    assert rows(numbered.select("n", "at")) == [(1, 2), (2, 5), (3, 6)]


def test_quoting_off_and_code_page(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('n;t\n1;"a\n2;b"\n'.encode())
    assert rows(delimited.read_delimited(spark, str(tmp_path), {}, quote="")) == [("1", '"a'), ("2", 'b"')]
    numbered = delimited.read_delimited(spark, str(tmp_path), {}, quote="", line_number="at")
    assert rows(numbered.select("n", "at")) == [("1", 2), ("2", 3)]
    (tmp_path / "b.txt").write_bytes('n;t\n1;"é€\n–"\n'.encode("cp1252"))
    assert rows(delimited.read_delimited(spark, str(tmp_path), {}, "*.txt", encoding="windows-1252")) == [("1", "é€\n–")]


def test_problems_hold_the_whole_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n;t\nx;"a\nb"\n1;"c\nd"\n2;"e\nf";3\n')
    found = delimited.read_delimited(spark, str(tmp_path), {"n": "int"}, problems="bad")
    assert rows(found.select("n", "t", "bad")) == sorted([(None, "a\nb", 'x;"a\nb"'), (1, "c\nd", None), (2, "e\nf", '2;"e\nf";3')], key=repr)


def test_no_lines():
    assert records.Scan(";", '"').take(pa.array([], pa.string()))[0][0].size == 0
