"""The four studies on a small industry, checked against plain pandas."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cotaflow.plans import studies
from cotaflow.sources import schemas

TYPES = {
    "Renda Fixa": ["Renda Fixa Simples", "Renda Fixa Duração Livre Soberano", "Renda Fixa Dívida Externa"],
    "Multimercados": ["Multimercados Livre", "Multimercados Macro", "Multimercados Trading", "Outros"],
    "Ações": ["Ações Livre", "Ações Setoriais", "Fechados de Ações"],
}


@pytest.fixture(scope="module")
def industry():
    r = random.Random(11)
    funds, daily, snapshots = [], [], []
    for number in range(60):
        category = list(TYPES)[number % 3]
        fund = f"{number:014d}"
        kind = r.choice(["Classe", "Classe", "Fundo"])
        funds.append((fund, category, r.choice(TYPES[category]), kind, r.choice("XY"), r.choice("PQ")))
        quota = 1.0
        for month in range(30):
            when = dt.date(2019 + month // 12, month % 12 + 1, 1 + number % 5)
            quota *= 1 + r.uniform(-0.05, 0.07) + (3 if r.random() < 0.002 else 0)
            money = [float(r.randint(0, 10**9)) for _ in range(3)]
            daily.append((fund, when, quota, *money))
        for _ in range(number % 4):
            flags = [r.choice(["S", "N", None]) for _ in range(5)]
            snapshots.append((fund, dt.date(2020, r.randint(1, 12), r.randint(1, 28)), r.choice(["A", "B", None]), *flags))
    classes = pd.DataFrame(funds, columns=["fund", "category", "type", "structure", "investor", "feature"])
    reports = pd.DataFrame(daily, columns=["fund", "dt", "quota", "balance", "inflow", "outflow"])
    states = pd.DataFrame(
        snapshots, columns=["fund", "dt", "policy", "mirror", "feeder", "entry_fee", "perf_fee", "exit_fee"]
    )
    rates = pd.DataFrame([(dt.date(y, m, 1), 0.5) for y in (2019, 2020, 2021) for m in range(1, 13)], columns=["dt", "rate_pct"])
    closes = pd.DataFrame([(dt.date(y, m, 3), 100.0 + 7 * m) for y in (2019, 2020, 2021) for m in range(1, 13)], columns=["dt", "close"])
    return classes, reports, states, rates, closes


@pytest.fixture(scope="module")
def tables(spark, industry):
    ddl = [
        "fund string, category string, type string, structure string, investor string, feature string",
        "fund string, dt date, quota double, balance double, inflow double, outflow double",
        "fund string, dt date, policy string, mirror string, feeder string, entry_fee string, perf_fee string, exit_fee string",
        "dt date, rate_pct double",
        "dt date, close double",
    ]
    found = []
    for table, columns in zip(industry, ddl):
        schema = to_arrow_schema(StructType.fromDDL(columns))
        found.append(spark.createDataFrame(pa.Table.from_pandas(table, schema, preserve_index=False)))
    return found


def facets(reports, part):
    return {(r.type, r.year): r for r in reports[part].collect()}


def expected_returns(industry, category, limit):
    classes, daily, states, _, _ = industry
    rows = daily.merge(classes[classes.category == category], on="fund")
    if category != "Renda Fixa":
        rows = rows[rows.fund.isin(states[states.policy.notna()].fund)]
    rows = rows.assign(year=[d.year for d in rows.dt]).sort_values("dt")
    ret = rows.groupby(["fund", "type", "year"]).quota.agg(lambda q: (q.iloc[-1] / q.iloc[0] - 1) * 100).reset_index()
    out = set(ret[ret.quota.abs() > limit].fund)
    return ret[~ret.fund.isin(out)], out


@pytest.fixture(params=["broadcast", "no broadcast"])
def limit_of_broadcasts(request, spark):
    """Lookups small enough to broadcast, and lookups that are not."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    if request.param == "no broadcast":
        spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_fixed_income(tables, industry, limit_of_broadcasts):
    classes, daily, states, rates, _ = tables
    reports = studies.fixed_income(daily, classes, states, rates)
    pc, pdaily, pstates = industry[0], industry[1], industry[2]
    shares = reports["type_share"].collect()
    want = pc[pc.category == "Renda Fixa"].type.value_counts()
    assert {r.type: r.n for r in shares} == want.to_dict()
    base = pdaily.merge(pc[pc.category == "Renda Fixa"], on="fund").merge(pstates[["fund", "policy"]], on="fund", how="left")
    base = base[base.policy.notna()]
    quarter = [dt.date(d.year, (d.month - 1) // 3 * 3 + 1, 1) for d in base.dt]
    sums = base.groupby(quarter)[["inflow", "outflow"]].sum() / 1e9
    got = {r.quarter: r for r in reports["quarterly_flow"].collect()}
    assert set(got) == set(sums.index)
    for q, row in sums.iterrows():
        assert got[q].inflow == pytest.approx(row.inflow) and got[q].outflow == pytest.approx(-row.outflow)
    kept, out = expected_returns(industry, "Renda Fixa", 50)
    kept = kept.assign(type=np.where(kept.type == "Renda Fixa Dívida Externa", "Outros", kept.type))
    found = facets(reports, "return_quartiles_1") | facets(reports, "return_quartiles_2")
    for key, group in kept.groupby(["type", "year"]):
        assert found[key].n == len(group)
        assert found[key].median == pytest.approx(group.quota.median())
        assert found[key].benchmark == pytest.approx((1.005**12 - 1) * 100)
    assert out and {t for t, _ in facets(reports, "return_quartiles_1")} == {"Renda Fixa Duração Livre Soberano"}


def test_multimarket_and_equity(tables, industry, limit_of_broadcasts):
    classes, daily, states, rates, closes = tables
    for reports, category, limit, line in (
        (studies.multimarket(daily, classes, states, rates), "Multimercados", 50, (1.005**12 - 1) * 100),
        (studies.equity(daily, classes, states, closes), "Ações", 500, (184 / 107 - 1) * 100),
    ):
        kept, _ = expected_returns(industry, category, limit)
        found = {}
        for part in (1, 2, 3):
            found |= facets(reports, f"return_quartiles_{part}")
        assert found
        for key, row in found.items():
            group = kept[(kept.type == key[0]) & (kept.year == key[1])].quota
            assert row.n == len(group) and row.benchmark == pytest.approx(line)
            if len(group):
                assert [row.q1, row.median, row.q3] == pytest.approx(list(np.percentile(group, [25, 50, 75])))
        labels = {r.quarter for r in reports["flow_by_type"].collect()}
        assert "2019 T1" in labels and len(labels) == 10
        assert reports["custody_by_type"].count() == reports["flow_by_type"].count()
        assert reports["latest_structure"].count() > 0 and reports["fee_matrix"].count() > 0
        assert reports["investor_profile"].count() > 0


def test_multimarket_flows(tables, industry, limit_of_broadcasts):
    classes, daily, _, rates, _ = tables
    reports = studies.multimarket_flows(daily, classes, rates)
    pc, pdaily = industry[0], industry[1]
    chosen = pc[(pc.category == "Multimercados") & (pc.structure == "Classe") & (pc.type != "Outros")]
    base = pdaily.merge(chosen, on="fund")
    base = base.assign(year=[d.year for d in base.dt], net=(base.inflow - base.outflow) / 1e9)
    yearly = base.groupby("year").net.sum()
    wide = {int(r.year): r for r in reports["annual_net_by_type"].collect()}
    assert {y: wide[y].total for y in wide} == pytest.approx(yearly.to_dict())
    assert sum(r.total for r in reports["annual_net_by_year"].collect()) == pytest.approx(yearly.sum())
    last = reports["cumulative_flow"].orderBy("month").collect()[-1]
    assert last.net_cum == pytest.approx(yearly.sum())
    for row in reports["reconciliation"].collect():
        assert row.net == pytest.approx(yearly[int(row.year)])
        assert row.change == pytest.approx(row.net + row.implied_return)
    closing = base.sort_values("dt").groupby(["fund", "year"]).balance.last().groupby("year").sum() / 1e9
    balances = {}
    for row in reports["year_end_balance"].collect():
        balances[int(row.year)] = balances.get(int(row.year), 0) + row.total
    assert balances == pytest.approx(closing.to_dict())
    assert all(r.type_short in ("Livre", "Macro", "Outros") for r in reports["return_boxes"].collect())
    assert {n for n in reports["type_year_counts"].columns} == {"type", *map(str, range(2015, 2026))}
    rolled = reports["rolling_flow"].groupBy("type").count().collect()
    assert rolled and all(r["count"] == 30 - 11 for r in rolled)


def test_stored_order_does_not_matter(spark, tables):
    """Two rows of a day and two snapshots of a day that differ: the same reports however the rows are stored."""
    classes, daily, states, rates, _ = tables
    daily = daily.union(daily.where("dt < '2020-01-01'").selectExpr("fund", "dt", "quota * 3", "balance", "inflow", "outflow"))
    states = states.union(states.selectExpr("fund", "dt", "'C'", "feeder", "mirror", "'S'", "'S'", "'N'"))

    def found(seed):
        mixed = [t.orderBy(F.rand(seed)).repartition(3) for t in (daily, states)]
        reports = studies.multimarket(mixed[0], classes, mixed[1], rates, limit=10_000)
        flows = studies.multimarket_flows(mixed[0], classes, rates)
        wanted = [reports[n] for n in ("return_quartiles_1", "latest_structure", "fee_matrix")] + [flows["reconciliation"], flows["returns"]]
        return [sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr) for df in wanted]

    assert found(1) == found(2)


def scans_of(df, path):
    """How often the plan of ``df`` reads the table at ``path``: leaves of its tree, whatever its text shows."""
    found = 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and hasattr(leaf.relation(), "location"):
            roots = leaf.relation().location().rootPaths()
            found += any(roots.apply(k).toUri().getPath() == path for k in range(roots.size()))
    return found


def test_a_study_reads_the_daily_rows_twice(spark, tables, tmp_path):
    """Once for the months and once for the years, whatever the number of reports."""
    classes, daily, states, rates, _ = tables
    path = str(tmp_path / "daily")
    daily.write.parquet(path)
    for run in (
        lambda rows: studies.fixed_income(rows, classes, states, rates),
        lambda rows: studies.multimarket_flows(rows, classes, rates),
    ):
        written = []
        original = studies.staged
        studies.staged = lambda df, label: (written.append(scans_of(df, path)), original(df, label))[1]
        try:
            reports = run(spark.read.parquet(path))
        finally:
            studies.staged = original
        scans = sum(written) + sum(scans_of(df, path) for df in reports.values())
        assert scans == 2


def test_published_names_of_the_small_tables(frame):
    assert schemas.rates(frame("date string, `4391` double", ("2024-01-01", 0.9))).first().dt == dt.date(2024, 1, 1)
    assert schemas.closes(frame("index date, `BVSP.Close` double", (dt.date(2024, 1, 2), 9.0))).first().close == 9.0
    ddl = ", ".join(f"`{n}` string" for n in schemas.JOB_COLUMNS)
    assert schemas.job_entries(frame(ddl)).columns == list(schemas.JOB_COLUMNS.values())


def test_from_landing_folder_to_study(spark, industry, tables, tmp_path):
    """The same study from published files and from ready tables."""
    import zipfile

    from cotaflow.plans import ingest
    from cotaflow.sources import delimited

    pc, pdaily, pstates, prates, _ = industry
    landed = tmp_path / "landed"
    landed.mkdir()
    names = {"dt": "DT_COMPTC", "quota": "VL_QUOTA", "balance": "VL_PATRIM_LIQ"}
    names |= {"inflow": "CAPTC_DIA", "outflow": "RESG_DIA"}

    def marked(fund):
        return f"{fund[:2]}.{fund[2:5]}.{fund[5:8]}/{fund[8:12]}-{fund[12:]}"

    raw = pdaily.rename(columns=names).assign(fund=pdaily.fund.map(marked), year=[d.year for d in pdaily.dt])
    for year, part in raw.groupby("year"):
        part = part.drop(columns="year")
        if year < 2021:
            text = part.rename(columns={"fund": "CNPJ_FUNDO"}).to_csv(sep=";", index=False)
            with zipfile.ZipFile(landed / f"{year}.zip", "w", zipfile.ZIP_DEFLATED) as out:
                out.writestr(f"inf_{year}.csv", text)
        else:
            new = part.rename(columns={"fund": "CNPJ_FUNDO_CLASSE"}).assign(TP_FUNDO_CLASSE="FIF")
            new.to_csv(landed / f"inf_{year}.csv", sep=";", index=False)

    ingest.consolidate(ingest.landed_reports(spark, str(landed)), str(tmp_path / "daily"))
    daily = spark.read.parquet(str(tmp_path / "daily"))
    assert daily.count() == len(pdaily)

    short = {v: k for k, v in schemas.CLASS_COLUMNS.items()}
    sheet = pc.rename(columns=short)
    for absent in set(short.values()) - set(sheet.columns):
        sheet[absent] = "x"
    (tmp_path / "classes").mkdir()
    sheet.to_csv(tmp_path / "classes" / "c.csv", sep=";", index=False)
    classes = schemas.classes(delimited.read_delimited(spark, str(tmp_path / "classes"), {}))

    short = {v: k for k, v in schemas.SNAPSHOT_COLUMNS.items()}
    extract = pstates.assign(fund=pstates.fund.map(marked)).rename(columns=short)
    for absent in set(short.values()) - set(extract.columns):
        extract[absent] = "é"
    (tmp_path / "extract").mkdir()
    extract.to_csv(tmp_path / "extract" / "e.csv", sep=";", index=False, encoding="cp1252")
    snapshots = schemas.snapshots(
        delimited.read_delimited(spark, str(tmp_path / "extract"), {}, quote="", encoding="windows-1252")
    )
    rates = spark.createDataFrame(pa.Table.from_pandas(prates, preserve_index=False))

    def values(reports):
        return {
            name: sorted(
                (tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect()), key=repr
            )
            for name, df in reports.items()
            if not name.startswith("return_density")
        }

    ready = tables[1], tables[0], tables[2], tables[3]
    assert values(studies.multimarket(daily, classes, snapshots, rates)) == values(studies.multimarket(*ready))
    ready = tables[1], tables[0], tables[3]
    assert values(studies.multimarket_flows(daily, classes, rates)) == values(studies.multimarket_flows(*ready))
