import datetime as dt
import os
import re
import zipfile
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cotaflow.plans import ingest
from cotaflow.sources import archives, delimited, files, periods, schemas, scratch, tables
from tests.conftest import rows

OLD = "CNPJ_FUNDO;DT_COMPTC;VL_QUOTA;VL_PATRIM_LIQ;CAPTC_DIA;RESG_DIA"
NEW = "TP_FUNDO_CLASSE;CNPJ_FUNDO_CLASSE;DT_COMPTC;VL_QUOTA;VL_PATRIM_LIQ;CAPTC_DIA;RESG_DIA"


def landing(folder):
    folder.mkdir(exist_ok=True)
    (folder / "200001.csv").write_text(f"{OLD}\n00.123.456/0001-90;2000-01-03; 1.5 ;10;1;2\n", "utf-8")
    (folder / "200002.csv").write_text(f"{OLD}\r\n00.123.456/0001-90;2000-02-03;1.6;;;\r\n", "utf-8")
    (folder / "202401.csv").write_text(f"﻿{NEW}\nFIF;11.222.333/0001-44;2024-01-02;2;20;3;4\n", "utf-8")
    (folder / "notes.txt").write_text("not a table", "utf-8")
    (folder / "empty.csv").write_text("", "utf-8")


def test_two_vintages_become_one_table(spark, tmp_path):
    landing(tmp_path / "in")
    raw = delimited.read_delimited(spark, str(tmp_path / "in"), schemas.DAILY_TYPES)
    assert set(raw.columns) == set(OLD.split(";")) | set(NEW.split(";"))
    found = rows(raw.select("CNPJ_FUNDO", "CNPJ_FUNDO_CLASSE", "TP_FUNDO_CLASSE", "VL_QUOTA", "CAPTC_DIA"))
    assert found == sorted(
        [
            ("00.123.456/0001-90", None, None, 1.5, 1.0),
            ("00.123.456/0001-90", None, None, 1.6, None),
            (None, "11.222.333/0001-44", "FIF", 2.0, 3.0),
        ],
        key=repr,
    )


def test_reports_have_one_clean_id(spark, tmp_path):
    landing(tmp_path / "in")
    reports = ingest.landed_reports(spark, str(tmp_path / "in"), archives=None)
    found = rows(reports.select("fund", "fund_kind", "dt", "quota"))
    assert found[0] == ("00123456000190", None, dt.date(2000, 1, 3), 1.5)
    assert found[2] == ("11222333000144", "FIF", dt.date(2024, 1, 2), 2.0)


def test_headers_come_without_reading_the_files(spark, tmp_path):
    landing(tmp_path / "in")
    found = {os.path.basename(r.file): r.header for r in delimited.file_headers(spark, str(tmp_path / "in")).collect()}
    assert found == {"200001.csv": OLD, "200002.csv": OLD, "202401.csv": NEW}  # an empty file is no file


def test_missing_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b;c;d\nNA; NA ;"";x\n1;;"NA";" y "\n2\n')
    found = rows(delimited.read_delimited(spark, str(tmp_path), {"a": "int"}))
    assert found == [(1, None, None, " y "), (2, None, None, None), (None, None, None, "x")]


def test_backslash_before_a_quote(spark, tmp_path):
    line = '"C:\\dir\\";x\\;"y;z"'
    (tmp_path / "a.csv").write_text(f"a;b;c\n{line}\n")
    archive(tmp_path / "a.zip", x=f"a;b;c\n{line}\n")
    expected = [("C:\\dir\\", "x\\", "y;z")]
    assert rows(delimited.read_delimited(spark, str(tmp_path), {})) == expected
    assert rows(archives.read_archives(spark, str(tmp_path), {}).select("a", "b", "c")) == expected


def test_archive_fields_follow_the_same_rules(spark, tmp_path):
    archive(tmp_path / "a.zip", x='a;b;c\nNA;"";"q;r"\n')
    found = archives.read_archives(spark, str(tmp_path), {"a": "int"}).select("a", "b", "c")
    assert rows(found) == [(None, None, "q;r")]


def test_no_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a")
    with pytest.raises(FileNotFoundError):
        delimited.read_delimited(spark, str(tmp_path), {})


def test_windows_code_page_without_quoting(spark, tmp_path):
    text = 'nome;nota\nAções "Livre;preço € 5 – “bom”…\n'
    (tmp_path / "a.csv").write_bytes(text.encode("cp1252"))
    found = delimited.read_delimited(spark, str(tmp_path), {}, quote="", encoding="windows-1252").first()
    assert (found.nome, found.nota) == ('Ações "Livre', "preço € 5 – “bom”…")


def test_every_windows_byte_is_decoded(spark):
    codes = [b for b in range(256) if bytes([b]).decode("cp1252", "ignore")]
    data = bytes(codes)
    wrong = spark.createDataFrame([(data.decode("latin-1"),)], "x string")
    assert wrong.select(delimited.cp1252_text(F.col("x"))).first()[0] == data.decode("cp1252")


def test_accented_header_in_code_page(spark, tmp_path):
    (tmp_path / "cv.csv").write_bytes("secao;Intituição;Fim\nprofissional;X;\n".encode("cp1252"))
    found = delimited.read_delimited(spark, str(tmp_path), {}, encoding="windows-1252")
    assert found.columns == ["secao", "Intituição", "Fim"]
    assert found.first()["Fim"] is None


def archive(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, text in members.items():
            out.writestr(f"{name}.csv", text)
        out.writestr("leia.txt", "nothing")


def test_archives_of_both_vintages(spark, tmp_path):
    archive(
        tmp_path / "2000.zip",
        jan=f"{OLD}\n00.1;2000-01-03;1;1;1;1\n00.1;2000-01-04;2;1;1;1",
        feb=f"{OLD}\r\n00.1;2000-02-01;3;1;1;1\r\n\r\n",
    )
    archive(tmp_path / "202401.zip", jan=f"{NEW}\nFIF;00.2;2024-01-02;4;1;1;1\n", bare="", only_header=f"{NEW}\n")
    (tmp_path / "x.csv").write_text("not;in;an;archive")
    raw = archives.read_archives(spark, str(tmp_path), schemas.DAILY_TYPES)
    found = rows(raw.select("member", "CNPJ_FUNDO", "CNPJ_FUNDO_CLASSE", "VL_QUOTA"))
    assert found == [
        ("feb.csv", "00.1", None, 3.0),
        ("jan.csv", "00.1", None, 1.0),
        ("jan.csv", "00.1", None, 2.0),
        ("jan.csv", None, "00.2", 4.0),
    ]


def test_members_stream_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BLOCK_BYTES", 7)

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            head, self.data = self.data[:n], self.data[n:]
            return head

    lines = [b"a;1", b"", b"a much longer line than a block;2", b"last"]
    got = [x.rstrip(b"\r") for block in archives._blocks(Stream(b"\r\n".join(lines))) for x in block]
    assert got == lines  # blank ones are left out where records are put together


def test_every_archive_line_arrives(spark, tmp_path):
    body = "\n".join(f"00.{i % 7};2000-01-03;{i};1;1;1" for i in range(200_000))
    archive(tmp_path / "big.zip", big=f"{OLD}\n{body}\n")
    raw = archives.read_archives(spark, str(tmp_path), schemas.DAILY_TYPES)
    assert raw.agg(F.count("*"), F.sum("VL_QUOTA")).first() == (200_000, float(sum(range(200_000))))


def test_table_modes(spark, tmp_path, frame):
    path = str(tmp_path / "t")
    first = frame("year int, x double", (2000, 1.0), (2001, 2.0))
    tables.write_table(first, path, "create", "year")
    with pytest.raises(AnalysisException):
        tables.write_table(first, path, "create", "year")
    tables.write_table(frame("year int, x double", (2001, 5.0)), path, "restate", "year", covers=["year"])
    assert rows(spark.read.parquet(path).select("year", "x")) == [(2000, 1.0), (2001, 5.0)]
    tables.write_table(frame("year int, x double", (2002, 7.0)), path, "replace", "year")
    assert rows(spark.read.parquet(path).select("year", "x")) == [(2002, 7.0)]
    with pytest.raises(ValueError):
        tables.write_table(first, path, "restate")
    with pytest.raises(ValueError):
        tables.write_table(first, path, "restate", "year")


def test_restating_a_month_leaves_the_others(spark, tmp_path, frame):
    path = str(tmp_path / "t")
    ddl = "fund string, dt date, inflow double"
    days = [dt.date(2024, m, d) for m in range(1, 13) for d in (1, 20)]
    ingest.consolidate(frame(ddl, *[("a", d, 1.0) for d in days], ("b", dt.date(2023, 12, 1), 1.0)), path)
    december = [("a", d, 2.0) for d in days[-2:]] + [("new", dt.date(2024, 12, 2), 3.0)]
    ingest.consolidate(frame(ddl, *december), path, "restate")
    found = spark.read.parquet(path).groupBy(F.year("dt"), F.month("dt")).agg(F.sum("inflow"), F.count("*"))
    assert rows(found) == sorted([(2023, 12, 1.0, 1), (2024, 12, 7.0, 3)] + [(2024, m, 2.0, 2) for m in range(1, 12)], key=repr)
    with pytest.raises(ValueError, match="lack"):
        ingest.consolidate(frame(ddl, ("a", days[-1], 9.0)), path, "restate")
    assert spark.read.parquet(path).agg(F.sum("inflow")).first()[0] == 30.0
    ingest.consolidate(frame(ddl, ("a", dt.date(2025, 1, 1), 4.0)), path, "restate")  # a month that is not there yet
    assert spark.read.parquet(path).agg(F.sum("inflow")).first()[0] == 34.0


def test_blank_first_lines_are_no_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n  \r\n\nx;y\n1;2\n\n3;4\n")
    (tmp_path / "b.csv").write_text("\n\n")
    archive(tmp_path / "a.zip", x="\n\nx;y\n5;6\n")
    assert rows(delimited.read_delimited(spark, str(tmp_path), {"x": "int"})) == [(1, "2"), (3, "4")]
    assert rows(archives.read_archives(spark, str(tmp_path), {"x": "int"}).select("x", "y")) == [(5, "6")]


def test_an_archive_without_a_matching_member_is_an_error(spark, tmp_path):
    (tmp_path / "202401.csv").write_text(f"{NEW}\nFIF;11.222.333/0001-44;2024-01-02;2;20;3;4\n")
    assert ingest.landed_reports(spark, str(tmp_path)).count() == 1  # no archive at all is fine
    with zipfile.ZipFile(tmp_path / "old.zip", "w") as out:
        out.writestr("inf.CSV", f"{OLD}\n00.123.456/0001-90;2000-01-03;1;10;1;2\n")
    with pytest.raises(ValueError, match="old.zip"):
        ingest.landed_reports(spark, str(tmp_path))


def test_lines_that_can_not_be_read_are_kept_and_told(spark, tmp_path):
    good, number, surplus, short = "1;1.5;a", "2;1,5;b", "3;2.5;c;d", "4;3.5"
    text = "\n".join(["n;x;t", good, number, surplus, short]) + "\n"
    (tmp_path / "a.csv").write_text(text)
    archive(tmp_path / "a.zip", x=text)
    types = {"n": "int", "x": "double"}
    for found in (
        delimited.read_delimited(spark, str(tmp_path), types, problems="bad"),
        archives.read_archives(spark, str(tmp_path), types, problems="bad").drop("archive", "member"),
    ):
        assert rows(found.select("n", "x", "bad")) == sorted(
            [(1, 1.5, None), (2, None, number), (3, 2.5, surplus), (4, 3.5, short)], key=repr
        )


def test_wide_tells_of_values_without_a_column(frame):
    from cotaflow.operators.reshape import wide

    table = frame("g int, k string, x double", (1, "a", 1.0), (1, "b", 2.0), (2, "c", 4.0))
    with pytest.raises(Exception, match="without a column: c"):
        wide(table, ["g"], "k", "x", {"a": "a", "b": "b"}).collect()
    found = wide(table, ["g"], "k", "x", {"a": "a", "b": "b"}, fill=0.0, total="t", others=True)
    assert rows(found) == [(1, 1.0, 2.0, 3.0), (2, 0.0, 0.0, 4.0)]


def test_ingest_works_from_another_folder(tmp_path):
    """The tasks find the package although the process starts elsewhere."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as contract
from cotaflow.session import local_session
spark = local_session(2, "elsewhere", "2g", spark__sql__warehouse__dir={str(tmp_path / "warehouse")!r})
for name in ("csv_two_vintages", "zip_ingest", "ingest_consolidated", "csv_codepage_roundtrip"):
    assert contract.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all read")
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "all read" in run.stdout, run.stderr[-2000:]


def test_periods_skip_partitions(spark, tmp_path, frame):
    from cotaflow.plans import base

    path = str(tmp_path / "t")
    reports = frame("fund string, dt date", *[("a", dt.date(y, m, 1)) for y in (2000, 2001, 2002) for m in (1, 5, 12)])
    ingest.consolidate(reports, path)
    daily = spark.read.parquet(path)
    years, quarters = base.within_years(daily, 2001, 2001), base.within_quarters(daily, (2000, 4), (2001, 1))
    for found, count in ((years, 3), (quarters, 2)):
        assert re.search(r"PartitionFilters: \[[^]]*dt_year", found._jdf.queryExecution().executedPlan().toString())
        assert found.count() == count


def test_clustered_files_are_sorted_by_fund_and_day(spark, tmp_path):
    """Also those of a fund with a third of the rows; the table is written in one pass over its input."""
    path = str(tmp_path / "t")
    days = F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 366).cast("int")).alias("dt")
    fund = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 50).cast("string")))
    ingest.consolidate(spark.range(30_000).select(fund.alias("fund"), days).repartition(6), path)
    assert spark.read.parquet(path).count() == 30_000
    for name in (p for p, _, names in os.walk(path) for n in names if n.endswith(".parquet") for p in [os.path.join(p, n)]):
        part = pq.read_table(name, columns=["fund", "dt"]).to_pylist()
        assert part == sorted(part, key=lambda r: (r["fund"], r["dt"]))


def test_year_filter_skips_partitions(spark, tmp_path, frame):
    path = str(tmp_path / "t")
    reports = frame("fund string, dt date", ("a", dt.date(2000, 5, 1)), ("a", dt.date(2001, 5, 1)))
    ingest.consolidate(reports, path)
    plan = spark.read.parquet(path).where(F.col("dt_year") == 2001)
    assert "PartitionFilters: [isnotnull(dt_year" in plan._jdf.queryExecution().executedPlan().toString()
    assert os.path.isdir(f"{path}/dt_year=2000/dt_month=5") and plan.count() == 1


def test_spines(frame):
    bounds = frame("first date, last date", (dt.date(2020, 11, 15), dt.date(2021, 2, 1)))
    assert [r.yyyymm for r in periods.monthly_spine(bounds).collect()] == ["202011", "202012", "202101", "202102"]
    assert [r.year for r in periods.yearly_spine(bounds).collect()] == [2020, 2021]


def test_shared_folder_comes_from_the_session(spark):
    def session(**settings):
        settings = {k.replace("_", ".").replace("..", "_"): v for k, v in settings.items()}
        conf = SimpleNamespace(get=lambda name, default=None: settings.get(name, default), set=settings.__setitem__)
        return SimpleNamespace(conf=conf)

    assert scratch.shared_folder(session(spark_checkpoint_dir="hdfs://nn/shared/")) == "hdfs://nn/shared"
    unset = session(spark_sql_warehouse_dir="hdfs://nn/warehouse")
    assert scratch.shared_folder(unset) == scratch.shared_folder(unset) == "hdfs://nn/warehouse/scratch"
    one, two = (scratch.scratch_path(spark, "a") for _ in range(2))
    assert one != two and one.startswith("file:/")


def test_staged_tables_go_when_their_work_is_done(spark):
    with scratch.Staging(spark) as stage:
        assert stage(spark.range(5), "five").count() == 5
        (path,) = stage.paths
        assert os.path.isdir(path.removeprefix("file:"))
    assert not os.path.isdir(path.removeprefix("file:"))


def test_paths_as_spark_reports_them(tmp_path):
    name = tmp_path / "a b%c.csv"
    name.write_text("h\n1\n")
    assert files.first_line(str(name), "utf-8") == "h"
    assert files.first_line(f"file:{name}", "utf-8") == "h"
    assert files.first_line(f"file://{name}", "utf-8") == "h"


def test_odd_file_names(spark, tmp_path):
    (tmp_path / "a b%20c.csv").write_text("x;y\n1;2\n")
    assert rows(delimited.read_delimited(spark, str(tmp_path), {"x": "int"})) == [(1, "2")]


def test_class_and_snapshot_columns(frame):
    ddl = ", ".join(f"`{n}` string" for n in schemas.CLASS_COLUMNS)
    assert schemas.classes(frame(ddl)).columns == list(schemas.CLASS_COLUMNS.values())
    ddl = ", ".join(f"`{n}` string" for n in schemas.SNAPSHOT_COLUMNS)
    raw = frame(ddl, tuple({"DT_COMPTC": "2024-01-02", "CNPJ_FUNDO_CLASSE": "0.1/2-3"}.get(n) for n in schemas.SNAPSHOT_COLUMNS))
    found = schemas.snapshots(raw).first()
    assert (found.fund, found.dt) == ("0123", dt.date(2024, 1, 2))


@pytest.mark.parametrize("sizes", [[1] * 50, [90, 3, 3, 3, 2, 2, 40, 41, 1, 1, 0, 88], [100], list(range(1, 60))])
def test_members_are_dealt_by_size(spark, frame, monkeypatch, sizes):
    monkeypatch.setattr(archives, "TASK_BYTES", 10)
    members = frame("archive string, member string, header string, size long", *[("a", str(i), "h", n) for i, n in enumerate(sizes)])
    found, tasks = archives.dealt(members)
    whole = max(10, *sizes)
    loads = {}
    for row in found.collect():
        assert 0 <= row.task < tasks
        loads[row.task] = loads.get(row.task, 0) + row.size
    assert sum(loads.values()) == sum(sizes) and max(loads.values()) <= 1.5 * whole
    spread = found.repartitionById(tasks, "task").select("task", F.spark_partition_id().alias("p"))
    assert all(row.task == row.p for row in spread.collect())
