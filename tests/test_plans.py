import datetime as dt
import math

import pytest

from cotaflow.functions.missing import skip_sum, strict_sum
from cotaflow.operators import ordered
from cotaflow.plans import balances, base, catalog, distributions, flows, profile, returns
from cotaflow.sources.tables import write_table
from tests.conftest import day, rows

DAILY = "fund string, dt date, quota double, balance double, inflow double, outflow double"


def report(fund, when, quota=1.0, balance=0.0, inflow=0.0, outflow=0.0):
    return fund, day(when), quota, balance, inflow, outflow


def test_study_classes_drop_the_repeated_and_the_unnamed_fund(frame):
    table = frame(
        "fund string, category string", (base.REPEATED_FUND, "Ações"), (None, "Ações"), ("1", "Ações"), ("2", "Renda Fixa")
    )
    assert rows(base.study_classes(table, "Ações")) == [("1", "Ações")]


def test_open_class_rows(frame):
    keep = ("1", "Multimercados", "Multimercados Livre", "Classe")
    table = frame(
        "fund string, category string, type string, structure string",
        keep,
        (None, *keep[1:]),
        (base.LEFT_OUT_FUNDS[0], *keep[1:]),
        ("2", "Ações", *keep[2:]),
        ("3", "Multimercados", None, "Classe"),
        ("4", "Multimercados", "Outros", "Classe"),
        ("5", *keep[1:3], "Fundo"),
    )
    assert rows(base.open_class_rows(table, "Multimercados")) == [keep]


def test_shares_add_up(frame):
    daily = frame(DAILY, *[report(str(i), "2020-01-01") for i in range(11)] * 2, report("x", "2020-01-01"))
    kinds = ["a"] * 5 + ["b"] * 3 + ["c"] * 3
    classes = frame("fund string, category string, type string", *[(str(i), "k", t) for i, t in enumerate(kinds)], ("99", "k", "a"))
    found = profile.type_share(daily, classes).collect()
    assert [(r.type, r.n) for r in found] == [("a", 5), ("b", 3), ("c", 3)]
    assert sum(r.share for r in found) == pytest.approx(100) and found[-1].share_cum == pytest.approx(100)
    assert len({r.share_cum for r in found}) == 3
    by = ["category", "type"]
    table = profile.with_total(profile.funds_per(daily, classes, by), by)
    assert rows(table.where("is_total").select("n")) == [(11,)] and table.count() == 4


@pytest.mark.parametrize("count, total, share", [(7687, 14939, 51.46), (2465, 4984, 49.46), (1427, 4984, 28.63)])
def test_published_shares(count, total, share):
    assert round(count / total * 100, 2) == share


def test_latest_structure_takes_undated_snapshots(frame):
    snapshots = frame(
        "fund string, dt date, seq int, policy string, mirror string, feeder string",
        ("1", None, 1, "a", None, None),
        ("1", day("2020-01-01"), 2, "b", "S", "N"),
        ("2", day("2020-01-01"), 1, "c", "S", "N"),
        ("2", day("2020-01-01"), 2, "d", "N", "S"),
        ("3", day("2020-01-01"), 1, "e", "N", "S"),
    )
    funds = frame("fund string", ("1",), ("2",))
    found = rows(profile.latest_structure(snapshots, funds, ["seq"]))
    assert found == [("a", "Não", "Sim", 1), ("d", "Não", "Sim", 1)]


@pytest.mark.parametrize("undated_last, expected", [(True, "a"), (False, "b")])
def test_latest_row_and_missing_dates(frame, undated_last, expected):
    table = frame("g int, dt date, seq int, v string", (1, None, 1, "a"), (1, day("2020-01-01"), 1, "b"))
    row = ordered.latest_row(["v"], "dt", ["seq"], undated_last).alias("row")
    assert table.groupBy("g").agg(row).first().row.v == expected


def test_fee_matrix_counts_fund_dates(frame):
    row = ("1", day("2020-01-01"), "p", "S", "N", None)
    snapshots = frame(
        "fund string, dt date, policy string, entry_fee string, perf_fee string, exit_fee string",
        row,
        row,
        ("1", day("2020-02-01"), *row[2:]),
        ("2", *row[1:]),
        ("9", *row[1:]),
    )
    found = rows(profile.fee_matrix(snapshots, frame("fund string", ("1",), ("2",))))
    assert found == [("p", "Sim", "Não", None, 3)]


def test_types_must_qualify_in_every_year(frame):
    counts = frame(
        "type string, year int, n bigint",
        *[("steady", y, 101) for y in (2015, 2016, 2017)],
        *[("dips", y, n) for y, n in ((2015, 500), (2016, 100), (2017, 500))],
        *[("absent", y, 500) for y in (2015, 2017)],
    )
    assert [r.type for r in profile.qualified_types(counts, 100).collect()] == ["steady"]
    classes = frame("fund string, type string", ("1", "steady"), ("2", "dips"), ("3", None))
    assert rows(profile.lump_unqualified(classes, profile.qualified_types(counts, 100)).select("fund", "type")) == [
        ("1", "steady"),
        ("2", "Outros"),
        ("3", "Outros"),
    ]


def test_wide_counts_have_zero_where_no_fund_reports(frame):
    daily = frame(DAILY, report("1", "2015-03-01"), report("1", "2015-04-01"), report("2", "2016-01-01"))
    classes = frame("fund string, type string", ("1", "a"), ("2", "b"))
    assert rows(profile.type_year_counts_wide(daily, classes, 2015, 2016)) == [("a", 1, 0), ("b", 0, 1)]


def test_quarterly_flow(frame):
    daily = frame(
        DAILY,
        report("1", "2020-01-05", inflow=5e9, outflow=1e9),
        report("1", "2020-03-31", inflow=1e9),
        report("2", "2020-04-01", outflow=2e9),
        report("2", "2021-01-01", inflow=9e9),
        report("9", "2020-01-05", inflow=9e9),
    )
    classes = frame("fund string, type string", ("1", "a"), ("2", "b"))
    found = rows(flows.quarterly_flow(daily, classes, (2020, 1), (2020, 4)))
    assert found == [(day("2020-01-01"), 6.0, -1.0, 5.0, 5.0), (day("2020-04-01"), 0.0, -2.0, -2.0, 3.0)]
    by_type = rows(flows.quarterly_flow_by_type(daily, classes, (2020, 1), (2020, 4)))
    assert [r[:2] for r in by_type] == [("2020 T1", "a"), ("2020 T2", "b")]


def test_missing_flow_in_a_quarter(frame):
    daily = frame(DAILY, ("1", day("2020-01-05"), 1.0, 1.0, None, 1.0), report("1", "2020-01-06", inflow=1e9))
    classes = frame("fund string, type string", ("1", "a"))
    span = (2020, 1), (2020, 1)
    strict = flows.quarterly_flow_by_type(daily, classes, *span, rule=strict_sum).first()
    assert strict.inflow is None and strict.net is None and strict.outflow == -1e-9
    assert flows.quarterly_flow_by_type(daily, classes, *span, rule=skip_sum).first().inflow == 1.0


def test_wide_annual_flows_agree(frame):
    daily = frame(
        DAILY,
        report("1", "2015-01-05", inflow=3e9),
        report("2", "2015-01-05", outflow=1e9),
        report("2", "2016-01-05", inflow=4e9),
    )
    classes = frame("fund string, type string", ("1", "a"), ("2", "b"))
    by_type = rows(flows.annual_net_by_type_wide(daily, classes, {"a": "a", "b": "b"}, 2015, 2016))
    assert by_type == [("2015", 3.0, -1.0, 2.0), ("2016", 0.0, 4.0, 4.0)]
    by_year = rows(flows.annual_net_by_year_wide(daily, classes, 2015, 2016))
    assert by_year == [("a", 3.0, 0.0, 3.0), ("b", -1.0, 4.0, 3.0)]


def test_monthly_net_is_the_sum_of_its_parts(frame):
    daily = frame(DAILY, report("1", "2015-01-05", inflow=3e9, outflow=1e9), ("1", day("2015-02-01"), 1.0, 1.0, None, None))
    classes = frame("fund string, type string", ("1", "a"))
    found = rows(flows.monthly_flow(daily, classes, 2015, 2015))
    assert found == [(day("2015-01-01"), 3.0, -1.0, 2.0), (day("2015-02-01"), 0.0, 0.0, 0.0)]


def test_balance_reconciles(frame):
    daily = frame(
        DAILY,
        report("1", "2015-06-01", balance=1e9),
        report("1", "2015-12-30", balance=10e9, inflow=2e9),
        report("2", "2015-11-30", balance=5e9),
        report("1", "2017-12-29", balance=21e9, inflow=4e9, outflow=1e9),
        report("9", "2017-12-29", balance=100e9),
    )
    classes = frame("fund string, type string", ("1", "a"), ("2", "b"))
    closing = balances.fund_years(daily, 2015, 2017, ["dt"])
    assert rows(balances.year_end_balance(closing, classes)) == [
        (2015, "a", 10.0, day("2015-12-30")),
        (2015, "b", 5.0, day("2015-11-30")),
        (2017, "a", 21.0, day("2017-12-29")),
    ]
    found = balances.reconciliation(closing, classes).first()
    assert (found.year, found.balance, found.net, found.change) == ("2017", 21.0, 3.0, 6.0)
    assert found.change == pytest.approx(found.net + found.implied_return)
    wide = rows(balances.year_end_balance_wide(closing, classes, {"a": "a", "b": "b"}))
    assert [(r[0], r[1].isoformat(), *r[2:]) for r in wide] == [
        ("2015", "2015-11-30", 0.0, 5.0, 5.0),
        ("2015", "2015-12-30", 10.0, 0.0, 10.0),
        ("2017", "2017-12-29", 21.0, 0.0, 21.0),
    ]


def test_custody_adds_up_days(frame):
    daily = frame(DAILY, report("1", "2020-01-01", balance=1e9), report("1", "2020-01-02", balance=1e9))
    classes = frame("fund string, type string", ("1", "a"))
    assert balances.custody_sum(daily, classes, (2020, 1), (2020, 4)).first().custody == 2.0


@pytest.fixture
def quotas(frame):
    data = [("gap", "2020-01-01", None), ("gap", "2020-01-02", 1.0), ("gap", "2020-01-04", 4.0)]
    data += [("zero", "2020-01-01", 0.0), ("zero", "2020-01-02", 5.0)]
    data += [("fine", "2020-01-01", 2.0), ("fine", "2020-12-30", 3.0), ("fine", "2021-01-04", 3.0), ("fine", "2021-02-01", 2.4)]
    return frame("fund string, dt date, quota double", *[(f, day(d), q) for f, d, q in data])


def test_annual_return(quotas):
    found = {(r.fund, r.year): r.ret for r in returns.annual_return(quotas, 2020, 2021, ["dt"]).collect()}
    assert found[("gap", 2020)] is None and found[("zero", 2020)] == math.inf
    assert found[("fine", 2020)] == pytest.approx(50) and found[("fine", 2021)] == pytest.approx(-20)
    present = returns.annual_return(quotas, 2020, 2020, ["dt"], skip_missing=True)
    found = {r.fund: r.ret for r in present.collect()}
    assert found["gap"] == pytest.approx(300) and len(found) == 3
    assert [r.fund for r in returns.plausible(present).collect()] == ["fine"]
    nulls = returns.annual_return(quotas, 2020, 2020, ["dt"], zero="null")
    assert nulls.where("fund = 'zero'").first().ret is None


def test_return_bounds_are_open(frame):
    values = frame("ret double", (-100.0,), (-99.9,), (299.9,), (300.0,), (None,), (math.nan,), (math.inf,))
    assert rows(returns.plausible(values)) == [(-99.9,), (299.9,)]


def test_a_fund_goes_with_all_its_years(frame):
    table = frame(
        "fund string, year int, ret double",
        ("1", 2020, 10.0),
        ("1", 2021, 51.0),
        ("2", 2020, 50.0),
        ("2", 2021, math.nan),
        (None, 2020, 1.0),
        ("3", 2020, -51.0),
        ("3", 2021, None),
    )
    assert {(r.fund, r.year) for r in returns.without_outlier_funds(table, 50).collect()} == {
        ("2", 2020),
        ("2", 2021),
        (None, 2020),
    }
    assert rows(returns.outlier_funds(table, 50)) == [("1",), ("3",)]


def test_index_without_its_bad_date(frame):
    closes = frame(
        "dt date, close double", (day("2012-01-02"), 1.0), (day("2012-01-03"), 100.0), (day("2012-12-28"), 107.4)
    )
    assert returns.index_by_year(closes, 2012, 2012, dt.date(2012, 1, 2)).first().benchmark == pytest.approx(7.4)


def test_rates_compound_within_a_year(frame):
    rates = frame("dt date, rate_pct double", *[(dt.date(2020, m, 1), 1.0) for m in (1, 2, 3)], (day("2021-01-01"), 2.0))
    assert dict(returns.rate_by_year(rates, 2020, 2021).collect()) == pytest.approx({2020: 3.0301, 2021: 2.0})
    running = [r.running for r in returns.rate_running(rates).orderBy("dt").collect()]
    assert running == pytest.approx([1.0, 2.01, 3.0301, 2.0])


def test_untyped_fund_keeps_its_row(frame):
    fund_years = frame("fund string, year int, ret double", ("1", 2020, 1.0), (None, 2020, 2.0), ("9", 1999, 3.0))
    classes = frame("fund string, type string", ("1", "a"), ("1", "a"), (None, "n"))
    benchmark = frame("year int, benchmark double", (2020, 5.0))
    found = rows(returns.with_type_and_benchmark(fund_years, classes, benchmark).select("fund", "type", "benchmark"))
    assert found == [("1", "a", 5.0), ("9", None, None), (None, "n", 5.0)]


def test_facet_without_funds_keeps_its_line(frame):
    marked = frame(
        "type string, year int, benchmark double, ret double, is_out boolean",
        ("a", 2015, 1.0, 10.0, False),
        ("a", 2015, 1.0, 20.0, False),
        ("a", 2018, 2.0, 900.0, True),
        ("b", 2018, 2.0, 3.0, False),
    )
    for method in ("builtin", "select"):
        found = rows(distributions.return_quartiles(marked, method))
        assert found == [
            ("a", 2015, 1.0, 1, 2, 12.5, 15.0, 17.5),
            ("a", 2018, 2.0, 2, 0, None, None, None),
            ("b", 2018, 2.0, 2, 1, 3.0, 3.0, 3.0),
        ]


def test_main_types_and_trimming(frame):
    data = [("t1", str(i), 2020, float(i)) for i in range(8)] + [("t1", "x", 2020, 250.0), ("t2", "y", 2020, 1.0)]
    table = frame("type string, fund string, year int, ret double", *data)
    assert rows(returns.main_types(table, 1)) == [("t1", 9)]
    kept = returns.trimmed_returns(table, 1, prefix="t").collect()
    assert sorted(r.ret for r in kept) == [float(i) for i in range(8)]


def test_one_folder_per_institution(spark, frame, tmp_path):
    entries = frame("section string, institution string, end string", ("profissional", "X", None), ("profissional", "Y", "1"))
    write_table(catalog.job_table(entries), str(tmp_path / "t"), "create", "institution")
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["institution=X", "institution=Y"]


def test_job_table(frame):
    entries = frame(
        "section string, institution string, role string, end string",
        ("profissional", "X", "a", None),
        ("profissional", "X", "b", "2020"),
        ("academica", "Y", "c", "2019"),
        ("profissional", None, "d", "2018"),
    )
    found = catalog.job_table(entries)
    assert rows(found) == [("X", "a", "Atual"), ("X", "b", "2020")]


def test_published_category_counts(frame):
    funds = "fundos de investimentos"
    posts = frame(
        "title string, dt date, categories array<string>",
        ("post 4", day("2026-06-14"), [funds, "multimercado", "captação"]),
        ("post 3", day("2025-04-22"), [funds, "desempenho", "fundos de ações"]),
        ("post 2", day("2025-04-11"), [funds, "desempenho", "multimercado"]),
        ("post 1", day("2025-04-02"), [funds, "desempenho", "renda fixa"]),
    )
    assert dict(catalog.category_counts(posts).collect()) == {
        "Tudo": 4,
        "captação": 1,
        "desempenho": 3,
        "fundos de ações": 1,
        funds: 4,
        "multimercado": 2,
        "renda fixa": 1,
    }
    newest = [r.title for r in catalog.listing_page(posts, ["title"], 3).collect()]
    assert newest == ["post 4", "post 3", "post 2"]
    assert [r.title for r in catalog.in_category(posts, "multimercado").orderBy("title").collect()] == ["post 2", "post 4"]


def test_post_without_categories_counts_in_all(frame):
    posts = frame("categories array<string>", (None,), ([],), (["a", "a"],))
    assert dict(catalog.category_counts(posts).collect()) == {"Tudo": 3, "a": 1}


def test_reading_time_counts_words(frame):
    posts = frame("text string", ("  one two\n\tthree ",), ("w " * 201,), ("",))
    assert [(r.words, r.minutes) for r in catalog.reading_time(posts).collect()] == [(3, 1), (201, 2), (0, 0)]
