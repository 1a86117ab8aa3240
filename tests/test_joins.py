import pytest
from pyspark.sql import functions as F

from cotaflow.functions.missing import skip_sum, strict_sum, zero_sum
from cotaflow.operators import joins
from cotaflow.operators.totals import totals_by_lookup
from cotaflow.plans import base, partials
from tests.conftest import rows


@pytest.fixture
def facts(frame):
    return frame(
        "fund int, q int, x double",
        (1, 1, 10.0),
        (1, 2, 20.0),
        (1, 2, None),
        (2, 1, 5.0),
        (3, 1, 7.0),
        (None, 1, 9.0),
    )


@pytest.fixture
def lookup(frame):
    return frame("fund int, type string", (1, "a"), (2, "a"), (3, None), (4, "b"), (None, "n"))


def test_missing_keys_match_only_on_request(facts, lookup):
    plain = joins.lookup_join(facts, lookup, "fund")
    matched = joins.lookup_join(facts, lookup, "fund", nulls_match=True)
    assert plain.where(F.col("fund").isNull()).first()["type"] is None
    assert matched.where(F.col("fund").isNull()).first()["type"] == "n"
    assert plain.columns == matched.columns == ["fund", "q", "x", "type"]


def test_membership(facts, frame):
    out = frame("fund int", (1,))
    assert joins.drop_members(facts, out, "fund").count() == 3
    assert joins.keep_members(facts, out, "fund").count() == 3
    with_null = frame("fund int", (1,), (None,))
    assert joins.drop_members(facts, with_null, "fund").count() == 2
    assert joins.keep_members(facts, with_null, "fund").count() == 3
    assert joins.keep_members(facts, with_null, "fund", nulls_match=True).count() == 4


def test_left_join_then_filter_is_an_inner_join(facts, lookup):
    left = facts.join(lookup, "fund", "left").where(F.col("type") == "a")
    inner = base.classified_daily(facts, lookup.where(F.col("type") == "a"))
    assert rows(left) == rows(inner)


def test_weights_equal_the_repeated_rows(facts, lookup, frame):
    snapshots = frame("fund int, policy string", (1, "p"), (1, "q"), (1, None), (2, "p"), (5, "p"))
    joined = facts.join(lookup, "fund").join(snapshots, "fund", "left").where(F.col("policy").isNotNull())
    repeated = joined.groupBy("q", "type").agg(skip_sum(F.col("x")).alias("x"))
    weighted = totals_by_lookup(
        facts, lookup, {"q": F.col("q")}, {"x": F.col("x")}, ["type"], skip_sum, base.with_policy(snapshots)
    )
    assert rows(weighted) == rows(repeated)
    once = totals_by_lookup(
        facts, lookup, {}, {"x": F.col("x")}, [], skip_sum, base.once_per_fund(base.with_policy(snapshots))
    )
    assert once.first()["x"] == 35.0


def test_fan_out_of_three_snapshots(frame):
    facts, lookup = frame("fund int, x double", (1, 10.0)), frame("fund int, type string", (1, "a"))
    snapshots = frame("fund int, policy string", (1, "p"), (1, "p"), (1, "p"))
    weights = base.with_policy(snapshots)
    found = [
        totals_by_lookup(facts, lookup, {}, {"x": F.col("x")}, ["type"], skip_sum, w).first()["x"]
        for w in (weights, base.once_per_fund(weights))
    ]
    assert found == [30.0, 10.0]


@pytest.mark.parametrize("rule", [strict_sum, skip_sum, zero_sum])
@pytest.mark.parametrize("weighted", [False, True])
def test_both_plans_agree(spark, facts, lookup, frame, rule, weighted):
    weights = frame("fund int, weight bigint", (1, 2), (2, 1), (3, 4)) if weighted else None
    repeated = lookup.union(lookup.where("fund = 1"))

    def run():
        return totals_by_lookup(facts, repeated, {"q": F.col("q")}, {"x": F.col("x")}, ["type"], rule, weights)

    direct = run()
    assert "BroadcastHashJoin" in direct._jdf.queryExecution().executedPlan().toString()
    small = rows(direct)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        large = run()
        assert rows(large) == small
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set(name, before)


def test_joins_of_raw_rows_split_a_hot_fund(spark):
    """A third of the rows has one key; the adaptive planner spreads it over several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        fund = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000)
        daily = spark.range(0, 60_000, 1, 6).select(fund.alias("fund"), F.rand(1).alias("x"), F.rand(2).alias("y"))
        lookup = spark.range(5000).select(F.col("id").alias("fund"), F.col("id").alias("type"))
        snapshots = spark.range(20_000).select(
            (F.col("id") % 5000).alias("fund"), F.lit(None).cast("date").alias("dt"), "id", F.col("id").alias("policy")
        )
        for joined in (
            base.classified_daily(daily, lookup),
            joins.lookup_join(daily, lookup, "fund", nulls_match=True),
            joins.keep_members(daily, lookup, "fund"),
            joins.drop_members(daily, lookup.where("fund % 2 = 1"), "fund"),
            base.with_latest_snapshot(daily, snapshots, ["policy"], ["id"]),
        ):
            joined.collect()
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


# Sizes from which on the planner filters a scan by the other side of a join.
FILTER_SIZE = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


def rows_summed(df):
    """Rows that reach the first aggregation or sort in the plan that has run, by the metrics of its filters."""
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            walk(node.finalPhysicalPlan())
        elif name.endswith("QueryStageExec"):
            walk(node.plan())
        elif name == "FilterExec" and "might_contain" in node.condition().toString():
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture
def industry_tables(spark, tmp_path):
    """20 000 daily rows of 200 funds, 10 of category A."""
    spark.range(20_000).selectExpr(
        "cast(id % 200 AS string) AS fund", "date_add(date'2020-01-01', cast(id / 200 AS int)) AS dt", "cast(id AS double) AS quota",
        "1.0D AS balance", "2.0D AS inflow", "CASE WHEN id % 7 > 0 THEN 1.0D END AS outflow",
    ).write.parquet(str(tmp_path / "daily"))
    spark.range(200).selectExpr("cast(id AS string) AS fund", "if(id < 10, 'A', 'B') AS category").write.parquet(str(tmp_path / "classes"))
    return spark.read.parquet(str(tmp_path / "daily")), spark.read.parquet(str(tmp_path / "classes"))


@pytest.mark.parametrize("category, funds", [("A", 10), ("B", 190), ("none", 0)])
def test_a_long_list_of_funds_is_filtered_at_the_scan(spark, industry_tables, no_broadcast, category, funds):
    """Rows summed follow the share of the category, but for the filter's errors; the result is the same without it."""
    daily, classes = industry_tables
    chosen = base.study_classes(classes, category)
    sums = (
        partials.fund_months,
        lambda rows: partials.fund_years(rows, 2020, 2020, partials.total_order(rows, ["dt"])),
    )
    for summarise in sums:
        plain = base.for_funds(daily, chosen, summarise)
        want = rows(plain)
        assert not rows_summed(plain)
        before = spark.conf.get(FILTER_SIZE)
        spark.conf.set(FILTER_SIZE, "1")
        try:
            found = base.for_funds(daily, chosen, summarise)
            assert rows(found) == want and len({r[0] for r in want}) == funds
            summed = rows_summed(found)
        finally:
            spark.conf.set(FILTER_SIZE, before)
        assert len(summed) == (funds > 0)  # without funds nothing is left of the plan
        assert all(funds * 100 <= n <= funds * 100 + 1_000 for n in summed)


def test_a_short_list_of_funds_is_joined_below_the_sums(spark, industry_tables):
    daily, classes = industry_tables
    plan = base.for_funds(daily, base.study_classes(classes, "A"), partials.fund_months)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert text.index("Aggregate") < text.index("Join LeftSemi")
