"""Random small tables against plain Python."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotaflow.functions.missing import skip_sum, strict_sum, zero_sum
from cotaflow.operators import ordered, reshape, windows
from cotaflow.operators.totals import totals_by_lookup

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
money = st.one_of(st.none(), st.integers(-1000, 1000).map(float))
key = st.one_of(st.none(), st.integers(0, 4))


def strict(xs):
    return None if None in xs else sum(xs)


def skipping(xs):
    kept = [x for x in xs if x is not None]
    return sum(kept) if kept else None


def from_zero(xs):
    return sum(x for x in xs if x is not None)


@few
@given(
    facts=st.lists(st.tuples(key, st.integers(0, 2), money), max_size=40),
    lookup=st.lists(st.tuples(key, st.sampled_from(["a", "b", None])), max_size=8),
    weights=st.one_of(st.none(), st.dictionaries(st.integers(0, 4), st.integers(1, 5))),
    rule=st.sampled_from([(strict_sum, strict), (skip_sum, skipping), (zero_sum, from_zero)]),
    broadcast=st.booleans(),
)
def test_totals(spark, frame, facts, lookup, weights, rule, broadcast):
    in_spark, in_python = rule
    groups = {}
    for fund, period, x in facts:
        for other, kind in lookup:
            if fund is not None and fund == other and (weights is None or fund in weights):
                repeat = 1 if weights is None else weights[fund]
                groups.setdefault((period, kind), []).extend([x] * repeat)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, before if broadcast else "-1")
    try:
        found = totals_by_lookup(
            frame("fund int, q int, x double", *facts),
            frame("fund int, type string", *lookup),
            {"q": F.col("q")},
            {"x": F.col("x")},
            ["type"],
            in_spark,
            None if weights is None else frame("fund int, weight bigint", *weights.items()),
        ).collect()
    finally:
        spark.conf.set(name, before)
    assert {(r.q, r.type): r.x for r in found} == {k: in_python(v) for k, v in groups.items()}


@few
@given(
    data=st.lists(
        st.tuples(st.integers(0, 3), st.integers(0, 5), money), max_size=40, unique_by=lambda r: (r[0], r[1])
    )
)
def test_first_and_last(frame, data):
    table = frame("g int, i int, x double", *data).repartition(3)
    found = table.groupBy("g").agg(
        ordered.first_value("x", ["i"]).alias("first"),
        ordered.last_value("x", ["i"]).alias("last"),
        ordered.first_value("x", ["i"], skip_missing=True).alias("first_present"),
        ordered.last_value("x", ["i", "g"], skip_missing=True).alias("last_present"),
    )
    want = {}
    for g in {r[0] for r in data}:
        xs = [x for _, _, x in sorted((r for r in data if r[0] == g), key=lambda r: r[1])]
        present = [x for x in xs if x is not None] or [None]
        want[g] = (xs[0], xs[-1], present[0], present[-1])
    assert {r.g: tuple(r)[1:] for r in found.collect()} == want


@few
@given(values=st.lists(money, max_size=30), rows=st.integers(1, 6))
def test_trailing_and_running_sums(frame, values, rows):
    table = frame("i int, x double", *enumerate(values))
    order = [F.asc("i")]
    found = table.select(
        "i",
        windows.trailing_sum("x", rows, order).alias("trailing"),
        windows.running_sum("x", order).alias("running"),
        windows.step_change("x", order).alias("step"),
    )
    for r in found.collect():
        window = values[max(0, r.i - rows + 1) : r.i + 1]
        assert r.trailing == (strict(window) if len(window) == rows else None)
        assert r.running == strict(values[: r.i + 1])
        pair = values[r.i - 1 : r.i + 1]
        assert r.step == (None if r.i == 0 or None in pair else pair[1] - pair[0])


@few
@given(
    cells=st.dictionaries(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", "c"])), money, max_size=12),
    fill=st.sampled_from([None, 0.0]),
)
def test_wide(frame, cells, fill):
    table = frame("g int, name string, x double", *[(g, n, x) for (g, n), x in cells.items()])
    found = reshape.wide(table, ["g"], "name", "x", {"A": "a", "B": "b"}, fill=fill, others=True)
    want = {g: (cells.get((g, "a"), fill), cells.get((g, "b"), fill)) for g, _ in cells}
    assert {r.g: (r.A, r.B) for r in found.collect()} == want


@few
@given(rates=st.lists(st.one_of(st.none(), st.floats(-50, 50)), min_size=1, max_size=12))
def test_compounding(frame, rates):
    table = frame("i int, r double", *enumerate(rates)).withColumn("y", F.lit(1))
    running = table.select("i", windows.running_compound("r", [F.asc("i")], ["y"]).alias("c")).orderBy("i").collect()
    factor = 1.0
    for r, rate in zip(running, rates, strict=True):
        factor = math.nan if rate is None else factor * (1 + rate / 100)
        assert r.c is None if math.isnan(factor) else r.c == pytest.approx((factor - 1) * 100, abs=1e-9)


def test_dates_of_any_century_keep_their_quarter(frame):
    from cotaflow.functions import periods

    days = [dt.date(y, m, 1) for y in (1900, 1970, 2000, 2199) for m in range(1, 13)]
    found = frame("d date", *[(d,) for d in days]).select("d", periods.quarter_start(F.col("d")), periods.quarter_label(F.col("d")))
    for d, start, label in found.collect():
        quarter = (d.month - 1) // 3 + 1
        assert start == dt.date(d.year, 3 * quarter - 2, 1) and label == f"{d.year} T{quarter}"
