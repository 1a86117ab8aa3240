"""Stored sums by month and year after months were published again, against a full recomputation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cotaflow.plans import ingest, partials, upkeep
from cotaflow.sources import swap, tables

from .conftest import rows

DDL = "fund string, dt date, seq int, quota double, balance double, inflow double, outflow double"
ORDER = ["dt", "seq"]


def some_rows(seed, months):
    r = random.Random(seed)

    def value():
        return None if r.random() < 0.15 else float(r.randint(0, 99))

    out = [
        (f, dt.date(y, m, r.randint(1, 28)), r.randint(1, 10**6), value(), value(), value(), value())
        for y, m in months for f in "abc" for _ in range(r.randint(0, 4))
    ]
    return out + [("u", None, 1, 1.0, 2.0, 3.0, None)]


MONTHS = [(y, m) for y in (2022, 2023, 2024) for m in (1, 2, 7)]


@pytest.mark.parametrize("skip", [False, True])
def test_refreshed_store_equals_recomputation(spark, tmp_path, frame, skip):
    daily, store = str(tmp_path / "daily"), str(tmp_path / "store")

    def check():
        table = spark.read.parquet(daily)
        assert rows(upkeep.months(spark, store).select("fund", "dt", "rows", *partials.MEASURES, "n_inflow", "n_outflow", "n_balance", "net")) == rows(
            partials.fund_months(table).select("fund", "dt", "rows", *partials.MEASURES, "n_inflow", "n_outflow", "n_balance", "net")
        )
        columns = ["fund", "year", "start", "end", "balance", "dt", "net"]
        assert rows(upkeep.years(spark, store).select(*columns)) == rows(partials.fund_years(table, 2000, 2030, ORDER, skip).select(*columns))

    ingest.consolidate(frame(DDL, *some_rows(1, MONTHS)), daily)
    present = spark.read.parquet(daily).select(*upkeep.PARTS).distinct()
    assert sorted(upkeep.refresh(spark, daily, store, ORDER, skip), key=repr) == rows(present)
    check()
    assert upkeep.refresh(spark, daily, store, ORDER, skip) == []
    ingest.consolidate(frame(DDL, ("a", dt.date(2023, 2, 9), 5, 7.0, None, 1.0, 2.0), ("z", dt.date(2025, 1, 9), 5, None, 3.0, 1.0, None)), daily, "merge")
    assert upkeep.refresh(spark, daily, store, ORDER, skip) == [(2023, 2), (2025, 1)]
    check()
    tables.drop_partitions(spark, daily, [(2022, m) for m in (1, 2, 7)] + [(2024, 7)], upkeep.PARTS)
    assert upkeep.refresh(spark, daily, store, ORDER, skip) == [(2022, 1), (2022, 2), (2022, 7), (2024, 7)]
    check()
    assert upkeep.years(spark, store).where("year = 2022").count() == 0


def test_only_changed_months_are_read(spark, tmp_path, frame, monkeypatch):
    daily, store = str(tmp_path / "daily"), str(tmp_path / "store")
    ingest.consolidate(frame(DDL, *some_rows(3, MONTHS)), daily)
    upkeep.refresh(spark, daily, store, ORDER)
    ingest.consolidate(frame(DDL, ("a", dt.date(2023, 7, 5), 1, 1.0, 1.0, 1.0, 1.0)), daily, "merge")
    seen, original = [], upkeep.monthly

    def monthly(chosen, *more):
        seen.append({tuple(r) for r in chosen.select(*upkeep.PARTS).distinct().collect()})
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [(dt_year" in plan.replace("(isnotnull(dt_year#", "(dt_year#") or "PartitionFilters: [isnotnull(dt_" in plan
        return original(chosen, *more)

    monkeypatch.setattr(upkeep, "monthly", monthly)
    assert upkeep.refresh(spark, daily, store, ORDER) == [(2023, 7)]
    assert seen == [{(2023, 7)}]


def test_a_refresh_that_fails_is_repeated(spark, tmp_path, frame, monkeypatch):
    daily, store = str(tmp_path / "daily"), str(tmp_path / "store")
    ingest.consolidate(frame(DDL, *some_rows(4, MONTHS)), daily)
    upkeep.refresh(spark, daily, store, ORDER)
    ingest.consolidate(frame(DDL, ("a", dt.date(2023, 7, 5), 1, 50.0, 1.0, 1.0, 1.0)), daily, "merge")

    def fails(*_):
        raise OSError("lost")

    for name in ("yearly", "monthly"):
        monkeypatch.setattr(upkeep, name, fails)
        with pytest.raises(OSError):
            upkeep.refresh(spark, daily, store, ORDER)
        monkeypatch.undo()
        upkeep.refresh(spark, daily, store, ORDER)
        years = upkeep.years(spark, store).select("fund", "year", "start", "end", "net")
        assert rows(years) == rows(partials.fund_years(spark.read.parquet(daily), 2000, 2030, ORDER).select("fund", "year", "start", "end", "net"))
        ingest.consolidate(frame(DDL, ("a", dt.date(2023, 7, 5), 1, 60.0, 1.0, 1.0, 1.0)), daily, "merge")
    assert not [n for n in swap.folders(spark, f"{store}/months") if n.startswith(swap.PREFIX)]
    assert spark.read.parquet(daily).where(F.col("fund") == "u").count() == 1
