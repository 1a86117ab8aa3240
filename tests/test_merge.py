"""Reports that are published again, merged into the table by fund and day."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cotaflow.plans import ingest
from cotaflow.sources import swap, tables

from .conftest import rows

DDL = "fund string, dt date, inflow double"
DAYS = [dt.date(2024, m, d) for m in (1, 2) for d in (1, 20)]
BASE = [(f, d, 1.0) for f in "ab" for d in DAYS] + [("a", DAYS[0], 1.5), (None, DAYS[0], 7.0), ("c", None, 8.0), ("c", None, 8.0)]


@pytest.fixture
def table(spark, tmp_path, frame):
    path = str(tmp_path / "daily")
    ingest.consolidate(frame(DDL, *BASE), path)
    return path


def held(spark, path):
    return rows(spark.read.parquet(path).select("fund", "dt", "inflow"))


def sort(data):
    return sorted(data, key=repr)


def test_a_fund_that_the_new_file_lacks_stays(spark, table, frame):
    ingest.consolidate(frame(DDL, ("a", DAYS[0], 2.0), ("n", DAYS[1], 3.0)), table, "merge")
    want = [r for r in BASE if r[:2] != ("a", DAYS[0])] + [("a", DAYS[0], 2.0), ("n", DAYS[1], 3.0)]
    assert held(spark, table) == sort(want)


def test_ending_what_is_absent(spark, table, frame):
    """Only in months that are published again; rows without fund or day stay."""
    ingest.consolidate(frame(DDL, ("a", DAYS[0], 2.0)), table, "merge", absent="end")
    want = [r for r in BASE if r[0] is None or r[1] is None or r[1].month == 2] + [("a", DAYS[0], 2.0)]
    assert held(spark, table) == sort(want)


def test_undated_rows(spark, table, frame):
    batch = frame(DDL, ("c", None, 8.0), ("c", None, 8.0), ("c", None, 8.0), ("d", None, None), (None, DAYS[0], 7.0), (None, DAYS[2], 9.0))
    with pytest.raises(ValueError, match="without"):
        ingest.consolidate(batch, table, "merge")
    assert held(spark, table) == sort(BASE)
    for _ in range(2):  # a second run changes nothing
        ingest.consolidate(batch, table, "merge", undated="add", absent="end")
        assert held(spark, table) == sort([*BASE, ("c", None, 8.0), ("d", None, None), (None, DAYS[2], 9.0)])


def test_restating_whole_months_minds_funds_and_undated_rows(spark, table, frame):
    with pytest.raises(ValueError, match="lack"):
        ingest.consolidate(frame(DDL, *[("a", d, 2.0) for d in DAYS[2:]]), table, "restate")
    with pytest.raises(ValueError, match="without"):
        ingest.consolidate(frame(DDL, *[(f, d, 2.0) for f in "ab" for d in DAYS[2:]], ("c", None, 1.0)), table, "restate")
    with pytest.raises(ValueError, match="lack"):  # the row without a fund
        ingest.consolidate(frame(DDL, *[(f, d, 2.0) for f in "ab" for d in DAYS[:2]]), table, "restate")
    assert held(spark, table) == sort(BASE)


def test_a_write_that_fails_changes_nothing(spark, table, frame):
    bad = frame(DDL, ("a", DAYS[0], 2.0), ("b", DAYS[2], 4.0)).withColumn("inflow", F.when(F.col("fund") == "b", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("inflow")))
    with pytest.raises(Exception, match="lost"):
        ingest.consolidate(bad, table, "merge")
    assert held(spark, table) == sort(BASE)
    ingest.consolidate(frame(DDL, ("a", DAYS[0], 2.0)), table, "merge")
    assert not [n for n in swap._Files(spark, table).folders(table) if n.startswith(swap.PREFIX)]


@pytest.mark.parametrize("moves", range(5))
def test_a_swap_that_is_cut_short_is_ended_later(spark, table, frame, monkeypatch, moves):
    """Whichever move is the last one: the next repair gives the merged table, or the old one if nothing was ready."""
    original, done = swap._Files.move, []

    def move(self, source, target):
        if len(done) == moves:
            raise OSError("gone")
        done.append(source)
        original(self, source, target)

    monkeypatch.setattr(swap._Files, "move", move)
    with pytest.raises(OSError):
        ingest.consolidate(frame(DDL, ("a", DAYS[0], 2.0), ("a", DAYS[2], 2.0)), table, "merge")
    monkeypatch.undo()
    swap.repair(spark, table)
    merged = [r for r in BASE if r[:2] not in (("a", DAYS[0]), ("a", DAYS[2]))] + [("a", DAYS[0], 2.0), ("a", DAYS[2], 2.0)]
    assert held(spark, table) == sort(merged if moves else BASE)


def test_only_touched_partitions_are_read_and_written(spark, table, frame):
    before = set(spark.read.parquet(table).select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    parts = ["dt_year", "dt_month"]
    assert tables.merge_table(frame(DDL + ", dt_year int, dt_month int", ("a", DAYS[0], 2.0, 2024, 1)), table, parts, ["fund", "dt"]) == [(2024, 1)]
    after = set(spark.read.parquet(table).select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert {f for f in before - after} and all("dt_month=1/" in f for f in before ^ after)
    assert tables.merge_table(frame(DDL + ", dt_year int, dt_month int"), table, parts, ["fund", "dt"]) == []
