"""Every registered query against its SQL twin, and the shape of the plans."""

import inspect
import re

import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as contract
import workload.oracles
import workload.queries
from checks.compare import connect, differences

SF = "/root/testdata/sf0.001"
# The operators for training data have tests of their own.
QUERIES, TWINS = workload.queries.QUERIES, workload.oracles.ORACLES

# Queries that first write files, and so are checked once only.
WRITING = {
    *("csv_two_vintages", "zip_ingest", "ingest_consolidated", "ingest_problems", "csv_codepage_roundtrip"),
    *("table_write_modes", "table_overwrite", "restate_month", "csv_quoted_breaks", "merge_published_again", "upkeep_of_partials"),
    *("classes_published", "snapshots_published", "rates_published", "closes_published"),
    *("study_fixed_income", "study_multimarket", "study_equity", "study_multimarket_flows"),
}


# No type has a hundred funds in the smallest tables; a test of their own splits the types there.
EMPTY_HERE = {"qualified_types", "qualified_types_strict"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_a_twin():
    assert QUERIES.keys() == TWINS.keys()
    assert QUERIES.keys() <= contract.queries().keys() and TWINS.keys() <= contract.oracle_sql().keys()


def test_qualification_splits_the_types(spark, duck):
    """At a limit between the types' fewest funds some stay and some are folded into the rest."""
    from cotaflow.plans import profile
    from workload import queries, tables

    counts = workload.oracles.with_roles("D C", "") + f", {workload.oracles.COUNTS} SELECT type, min(n) FROM N GROUP BY type"
    fewest = dict(duck.execute(counts).fetchall())
    limit = sorted(fewest.values())[2]
    kept = {t for t, n in fewest.items() if n > limit}
    assert 0 < len(kept) < len(fewest)
    qualified = profile.qualified_types(queries._type_years(spark, SF), limit)
    assert {r["type"] for r in qualified.collect()} == kept
    lumped = profile.lump_unqualified(tables.classes(spark, SF), qualified)
    assert {r["type"] for r in lumped.select("type").distinct().collect()} == kept | {"Outros"}


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["category", "type", "n", "share", "share_cum"] and found.count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_twin(spark, duck, name):
    assert not differences(spark, duck, SF, QUERIES[name], TWINS[name], may_be_empty=name in EMPTY_HERE)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - WRITING))
def test_query_without_broadcasts(spark, duck, no_broadcast, name):
    """The plans for lookups of any size give the same rows."""
    assert not differences(spark, duck, SF, QUERIES[name], TWINS[name], may_be_empty=name in EMPTY_HERE)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - WRITING))
def test_no_pairwise_joins(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan_of(QUERIES[name](spark, SF)))


def test_period_filter_reaches_the_scan(spark):
    plan = plan_of(QUERIES["quarterly_flow_by_type"](spark, SF))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(o_orderdate,1996-04-01", plan)
    schema = re.search(r"ReadSchema: struct<o_custkey[^>]*>", plan).group()
    assert "o_orderpriority" not in schema and "o_orderkey" not in schema


def test_daily_rows_are_summed_before_they_meet_a_large_lookup(spark, no_broadcast):
    plan = plan_of(QUERIES["quarterly_flow_by_type"](spark, SF))
    below_join = plan[plan.index("SortMergeJoin") :]
    assert below_join.count("partial_sum") == 2


def test_returns_need_no_sort_of_a_fund_by_day(spark):
    plan = plan_of(QUERIES["annual_return"](spark, SF))
    assert "Window" not in plan and "partial_min_by" in plan and "partial_max_by" in plan


def test_order_by_date_alone_stays_a_hash_aggregate(spark):
    from cotaflow.plans import returns
    from workload import tables

    plan = plan_of(returns.annual_return(tables.dense_daily(spark, SF), 1995, 2001, ["dt"]))
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2


def test_quartiles_read_the_daily_rows_once(spark):
    from cotaflow.operators import distribution
    from cotaflow.plans import returns
    from workload import queries

    marked = returns.mark_outlier_funds(queries._with_benchmark(spark, SF), 500)
    plan = plan_of(distribution.group_stats(marked, ["type", "year"], "ret", distribution.QUARTILES, "builtin"))
    assert len(re.findall("FileScan parquet [^\n]*l_extendedprice", plan)) == 1


def test_library_collects_no_tables():
    import pkgutil

    import cotaflow

    for module in pkgutil.walk_packages(cotaflow.__path__, "cotaflow."):
        if module.name.startswith("cotaflow.llm"):
            continue
        source = inspect.getsource(__import__(module.name, fromlist=["x"]))
        assert not re.search(r"\.(collect|toPandas|localCheckpoint|crossJoin)\(", source), module.name


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - WRITING))
def test_only_aggregated_rows_meet_in_one_task(spark, name):
    """Below every exchange to a single partition the rows come out of an aggregation."""
    lines = [re.sub(r"^[\s:+\-|]*(\*\(\d+\) )?", "", x) for x in plan_of(QUERIES[name](spark, SF)).splitlines()]
    for at, line in enumerate(lines):
        if line.startswith("Exchange SinglePartition"):
            below = next(x for x in lines[at + 1 :] if not x.startswith(("Project", "Filter", "Sort ", "Window")))
            assert re.match("(Hash|Sort|ObjectHash)Aggregate", below), below
