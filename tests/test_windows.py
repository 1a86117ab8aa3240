import datetime as dt

import pytest
from pyspark.sql import functions as F

from cotaflow.operators import ranking, reshape, windows
from cotaflow.plans import flows
from tests.conftest import rows


def months(n, start=2020):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.mark.parametrize("n, left", [(11, 0), (12, 1), (13, 2)])
def test_rolling_needs_twelve_rows(frame, n, left):
    monthly = frame("month date, type string, net double", *[(m, "a", 1.0) for m in months(n)])
    found = flows.rolling_flow(monthly).collect()
    assert len(found) == left and all(r.net_rolling == 12.0 for r in found)


def test_rolling_counts_rows_not_months(frame):
    kept = [m for m in months(14) if m.month != 6]
    monthly = frame("month date, type string, net double", *[(m, "a", 1.0) for m in kept])
    assert [r.net_rolling for r in flows.rolling_flow(monthly).collect()] == [12.0] * (len(kept) - 11)


def test_rolling_drops_windows_with_a_gap(frame):
    values = [None] + [1.0] * 12
    monthly = frame("month date, type string, net double", *[(m, "a", v) for m, v in zip(months(13), values)])
    assert [r.month for r in flows.rolling_flow(monthly).collect()] == [months(13)[-1]]


def test_rolling_is_a_difference_of_running_sums(frame):
    values = [(m, "a", float(i * i % 17)) for i, m in enumerate(months(40))]
    monthly = frame("month date, type string, net double", *values)
    running = {r.month: r.net_cum for r in flows.cumulative_flow(monthly, ["type"]).collect()}
    for r in flows.rolling_flow(monthly).collect():
        a_year_before = dt.date(r.month.year - 1, r.month.month, 1)
        assert r.net_rolling == pytest.approx(running[r.month] - running.get(a_year_before, 0.0))


def test_tied_counts_get_their_own_running_value(frame):
    counts = frame("type string, n double", ("a", 5.0), ("b", 3.0), ("c", 3.0))
    order = [F.desc("n"), F.asc("type")]
    assert [r.s for r in counts.select(windows.running_sum("n", order).alias("s")).collect()] == [5.0, 8.0, 11.0]


def test_running_sum_stays_missing(frame):
    values = frame("i int, x double", (1, 1.0), (2, None), (3, 4.0))
    found = values.select("i", windows.running_sum("x", [F.asc("i")]).alias("s")).orderBy("i").collect()
    assert [r.s for r in found] == [1.0, None, None]


def test_running_compound(frame):
    values = frame("i int, r double", (1, 1.0), (2, 1.0), (3, -100.0), (4, 5.0))
    found = values.select("i", windows.running_compound("r", [F.asc("i")]).alias("s")).orderBy("i").collect()
    assert [r.s for r in found] == pytest.approx([1.0, 2.01, -100.0, -100.0])


def test_change_goes_to_the_next_row_present(frame):
    yearly = frame("year int, x double", (2015, 1.0), (2017, 4.0))
    found = yearly.withColumn("d", windows.step_change("x", [F.asc("year")])).orderBy("year").collect()
    assert [r.d for r in found] == [None, 3.0]


def test_level_code_follows_the_values_present(frame):
    years = frame("year int", (2015,), (2018,), (2015,), (2020,))
    assert rows(years.select("year", windows.level_code("year"))) == [(2015, 1), (2015, 1), (2018, 2), (2020, 3)]


def test_wide_fills_absent_cells_only(frame):
    long = frame("t string, y int, n double", ("a", 1, 5.0), ("b", 1, None), ("b", 2, 7.0))
    columns = {"y1": 1, "y2": 2}
    assert rows(reshape.wide(long, ["t"], "y", "n", columns, fill=0.0)) == [("a", 5.0, 0.0), ("b", None, 7.0)]
    assert rows(reshape.wide(long, ["t"], "y", "n", columns)) == [("a", 5.0, None), ("b", None, 7.0)]


def test_row_total_and_numeric_columns(frame):
    table = frame("t string, a double, b double, n int, d date", ("x", 1.0, None, 2, None))
    assert reshape.numeric_columns(table, ["n"]) == ["a", "b"]
    assert table.select(reshape.row_total(["a", "b"])).first()[0] == 1.0


def test_largest_groups_break_ties_by_key(frame):
    counts = frame("k string, n bigint", ("c", 2), ("a", 2), ("b", 9), ("d", 1))
    assert [r.k for r in ranking.largest_groups(counts, "k", "n", 3).collect()] == ["b", "a", "c"]


def test_pages_cover_everything_once(frame):
    posts = frame("id int, dt date", *[(i, dt.date(2024, 1, 1 + i // 2)) for i in range(10)])
    pages = [[r.id for r in ranking.page(posts, "dt", ["id"], 4, n).collect()] for n in range(4)]
    assert pages == [[8, 9, 6, 7], [4, 5, 2, 3], [0, 1], []]
