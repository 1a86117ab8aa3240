"""Every registered query: (spark, folder of test tables) -> DataFrame.

Amounts and ratios are rounded so that the order in which a sum was formed does not show.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotaflow.functions import labels, missing, periods, report, text
from cotaflow.operators import distribution, joins, prefix, reshape, totals
from cotaflow.plans import active, balances, base, catalog, distributions, flows, ingest, profile, returns, studies, upkeep
from cotaflow.sources import archives, delimited, periods as spines, schemas, tables as store
from cotaflow.sources.scratch import scratch_path, staged
from workload import landing, tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEARS = (t.FIRST, t.LAST)
CENTS_OF_BILLIONS = 11  # digits that keep every cent of an amount in billions


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the given columns, or all floating-point ones."""
    names = columns or [n for n, kind in df.dtypes if kind == "double"]
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


# Base table and joins


@query
def base_left_then_filter(spark, sf):
    daily = schemas.daily_reports(t.raw_daily(spark, sf))
    wanted = base.study_classes(t.classes_by_text_id(spark, sf), "AMERICA", repeated="00000000000007")
    return base.classified_daily(daily, wanted, ["category", "type"])


@query
def base_open_classes(spark, sf):
    untyped = t.classes(spark, sf).withColumn("type", F.nullif(F.col("type"), F.lit("FURNITURE")))
    wanted = base.open_class_rows(untyped, "ASIA", left_out=[1, 2, 3, 4, 5])
    sums = totals.totals_by_lookup(
        t.daily(spark, sf), wanted, {}, {"inflow": F.col("inflow"), "rows": F.lit(1)}, ["type"], missing.zero_sum
    )
    return rounded(sums.withColumn("rows", F.col("rows").cast("bigint")), 2, "inflow")


@query
def semi_join_class(spark, sf):
    wanted = t.classes(spark, sf).where(F.col("category") == "EUROPE")
    return joins.keep_members(t.daily(spark, sf), wanted, "fund").select("fund", "dt", "seq", "quota")


def _daily_with_lost_ids(spark, sf):
    key = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey"))
    return t.table(spark, sf, "orders").select(key.alias("fund"), F.col("o_totalprice").alias("quota"))


@query
def semi_join_null_keys(spark, sf):
    rows = _daily_with_lost_ids(spark, sf)
    counts = rows.groupBy("fund").agg(F.count("*").alias("n"))
    large = rows.where(F.col("quota") > 490000).select("fund").distinct()
    return joins.keep_members(counts, large, "fund", nulls_match=True)


@query
def anti_join_outliers(spark, sf):
    rows = _daily_with_lost_ids(spark, sf)
    counts = rows.groupBy("fund").agg(F.count("*").alias("n"))
    large = rows.where((F.col("quota") > 450000) & F.col("fund").isNotNull()).select("fund").distinct()
    return joins.drop_members(counts, large, "fund")


@query
def not_in_lists(spark, sf):
    lost = F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM"))
    urgent = ["1-URGENT", "2-HIGH"]
    return t.table(spark, sf, "orders").agg(
        F.count_if(missing.not_in(lost, urgent)).alias("missing_kept"),
        F.count_if(~lost.isin(urgent)).alias("missing_dropped"),
        F.count_if(lost.isin(urgent)).alias("listed"),
    )


def _inflow_per_type(spark, sf, weights):
    inflow = {"inflow": F.col("inflow")}
    sums = totals.totals_by_lookup(
        t.daily(spark, sf), t.classes(spark, sf), {}, inflow, ["type"], missing.skip_sum, weights
    )
    return rounded(sums, 2)


@query
def snapshot_fanout_sum(spark, sf):
    return _inflow_per_type(spark, sf, base.with_policy(t.snapshots_with_gaps(spark, sf)))


@query
def snapshot_latest_sum(spark, sf):
    weights = base.with_policy(t.snapshots_with_gaps(spark, sf))
    return _inflow_per_type(spark, sf, base.once_per_fund(weights))


@query
def snapshot_latest_join(spark, sf):
    rows = t.daily(spark, sf).select("fund", "seq", "quota")
    return base.with_latest_snapshot(rows, t.snapshots(spark, sf), ["policy", "perf_fee"], ["seq"])


# Text, labels, periods and formats


@query
def clean_id_digits(spark, sf):
    name = F.col("c_name")
    return t.table(spark, sf, "customer").select("c_custkey", text.digits_only(name).alias("id"))


@query
def clean_id_charset(spark, sf):
    marked = t.punctuated_id(F.col("c_custkey"))
    return t.table(spark, sf, "customer").select(
        "c_custkey", marked.alias("marked"), text.drop_marks(marked).alias("id")
    )


@query
def name_parts(spark, sf):
    name, kind = F.col("p_name"), F.nullif(F.col("p_type"), F.lit("ECONOMY"))
    return t.table(spark, sf, "part").select(
        "p_partkey",
        text.short_name(name, "small").alias("short"),
        text.paste(F.col("p_brand"), kind, F.col("p_size"), sep="-").alias("pasted"),
        F.concat_ws("-", "p_brand", F.coalesce(kind, F.col("p_name"))).alias("label"),
        F.concat(F.col("p_brand"), kind).alias("joined"),
    )


@query
def flag_labels(spark, sf):
    return (
        t.snapshots(spark, sf)
        .groupBy(
            labels.mirror_label(F.col("mirror")).alias("mirror"),
            labels.feeder_label(F.col("feeder")).alias("feeder"),
            labels.fee_label(F.coalesce("mirror", F.lit("?"))).alias("fee"),
            labels.lump(F.nullif(F.col("policy"), F.lit("2-HIGH")), ["1-URGENT", "2-HIGH"]).alias("policy"),
        )
        .agg(F.count("*").alias("n"))
    )


@query
def period_labels(spark, sf):
    d = F.col("dt")
    year = F.year(d)
    return t.daily(spark, sf).groupBy("dt").agg(F.count("*").alias("n")).select(
        "dt",
        "n",
        year.alias("year"),
        periods.quarter_start(d).alias("quarter_start"),
        periods.quarter_label(d).alias("quarter_label"),
        periods.month_start(year, F.month(d)).alias("month_start"),
        periods.number_from_text(F.date_format(d, "MM")).alias("month"),
        periods.number_from_text(F.concat(F.lit("m"), F.date_format(d, "MM"))).isNull().alias("not_a_number"),
    )


@query
def type_share(spark, sf):
    return rounded(profile.type_share(t.daily(spark, sf), t.classes(spark, sf)), 6)


@query
def type_share_total(spark, sf):
    counts = profile.funds_per(t.daily(spark, sf), t.classes(spark, sf), ["category", "type"])
    return profile.with_total(counts, ["category", "type"])


@query
def format_report(spark, sf):
    shares = profile.type_share(t.daily(spark, sf), t.classes(spark, sf))
    return shares.select(
        "category",
        "type",
        report.thousands(F.col("n") * 1000).alias("funds"),
        report.percent(F.col("share")).alias("share"),
        report.axis_percent(F.col("share_cum")).alias("share_cum"),
        report.reais_billions(F.col("n") / 7).alias("amount"),
    )


# Profiles


@query
def investor_profile(spark, sf):
    return profile.investor_profile(t.daily(spark, sf), t.classes(spark, sf))


@query
def investor_profile_total(spark, sf):
    by = ["investor", "feature"]
    return profile.with_total(profile.funds_per(t.daily(spark, sf), t.classes(spark, sf), by), by)


def _funds_of(spark, sf, *categories):
    rows = t.classes(spark, sf).where(F.col("category").isin(*categories))
    return profile.reporting_funds_of(t.daily(spark, sf), rows)


@query
def latest_structure(spark, sf):
    funds = _funds_of(spark, sf, "AMERICA", "ASIA", "EUROPE")
    undated = t.snapshots(spark, sf).withColumn("dt", F.when(F.col("seq") % 97 != 0, F.col("dt")))
    return profile.latest_structure(undated, funds, ["seq"])


@query
def fee_matrix(spark, sf):
    return profile.fee_matrix(t.snapshots(spark, sf), _funds_of(spark, sf, "AFRICA", "AMERICA"))


@query
def type_year_counts_wide(spark, sf):
    return profile.type_year_counts_wide(t.daily(spark, sf), t.classes(spark, sf), *YEARS)


def _type_years(spark, sf):
    return profile.type_year_counts(t.daily(spark, sf), t.classes(spark, sf), *YEARS)


# Of the five types of the test tables at scale 0.01, all have this many funds in every year, or two have.
COMMON_TYPE, LARGE_TYPE = 100, 180


@query
def qualified_types(spark, sf):
    return profile.qualified_types(_type_years(spark, sf), more_than=COMMON_TYPE)


@query
def qualified_types_strict(spark, sf):
    return profile.qualified_types(_type_years(spark, sf), more_than=LARGE_TYPE)


@query
def qualified_lumped_counts(spark, sf):
    qualified = staged(profile.qualified_types(_type_years(spark, sf), more_than=LARGE_TYPE), "qualified")
    lumped = profile.lump_unqualified(t.classes(spark, sf), qualified)
    return lumped.groupBy("type").agg(F.count("*").alias("n"))


# Flows


def _daily_with_gaps(spark, sf):
    """Daily rows whose inflow is missing while the order is pending."""
    return t.daily(spark, sf).withColumn("inflow", F.when(F.col("status") != "P", F.col("inflow")))


def _per_fund(spark, sf, rule):
    sums = _daily_with_gaps(spark, sf).groupBy("fund").agg(rule(F.col("inflow")).alias("inflow"))
    return rounded(sums, 2)


@query
def sum_na_propagate(spark, sf):
    return _per_fund(spark, sf, missing.strict_sum)


@query
def sum_na_skip(spark, sf):
    return _per_fund(spark, sf, missing.skip_sum)


@query
def sum_na_zero(spark, sf):
    return _per_fund(spark, sf, missing.zero_sum)


@query
def quarterly_flow_cum(spark, sf):
    wanted = t.classes(spark, sf).where(F.col("category") == "AMERICA")
    return rounded(flows.quarterly_flow(t.daily(spark, sf), wanted, *t.QUARTERS), CENTS_OF_BILLIONS)


@query
def quarterly_flow_fanout(spark, sf):
    wanted = t.classes(spark, sf).where(F.col("category") == "AMERICA")
    weights = base.with_policy(t.snapshots_with_gaps(spark, sf))
    return rounded(flows.quarterly_flow(t.daily(spark, sf), wanted, *t.QUARTERS, weights), CENTS_OF_BILLIONS)


@query
def quarterly_net_by_category(spark, sf):
    columns = {name.lower().replace(" ", "_"): name for name in t.REGIONS}
    table = flows.quarterly_net_by_category(t.daily(spark, sf), t.classes(spark, sf), *t.QUARTERS, columns)
    return rounded(table, CENTS_OF_BILLIONS)


@query
def quarterly_flow_by_type(spark, sf):
    table = flows.quarterly_flow_by_type(_daily_with_gaps(spark, sf), t.classes(spark, sf), (1996, 2), (2000, 3))
    return rounded(table, CENTS_OF_BILLIONS)


@query
def quarterly_flow_by_type_strict(spark, sf):
    table = flows.quarterly_flow_by_type(
        _daily_with_gaps(spark, sf), t.classes(spark, sf), *t.QUARTERS, rule=missing.strict_sum, labelled=False
    )
    return rounded(table, CENTS_OF_BILLIONS)


@query
def quarterly_flow_by_type_lumped(spark, sf):
    lumped = profile.lump_types(t.classes(spark, sf), t.OPEN_TYPES)
    table = flows.quarterly_flow_by_type(
        t.daily(spark, sf), lumped, *t.QUARTERS, rule=missing.strict_sum, labelled=False
    )
    return rounded(table, CENTS_OF_BILLIONS)


@query
def annual_flow_wide_type(spark, sf):
    lumped = profile.lump_types(t.classes(spark, sf), t.OPEN_TYPES)
    columns = {name.lower(): name for name in [*t.OPEN_TYPES, labels.REST]}
    table = flows.annual_net_by_type_wide(t.daily(spark, sf), lumped, columns, *YEARS)
    return rounded(table, CENTS_OF_BILLIONS)


@query
def annual_flow_wide_year(spark, sf):
    lumped = profile.lump_types(t.classes(spark, sf), t.OPEN_TYPES)
    table = flows.annual_net_by_year_wide(t.daily(spark, sf), lumped, 1995, 2003)  # more years than there are
    return rounded(table, CENTS_OF_BILLIONS, *reshape.numeric_columns(table))


@query
def wide_keeps_missing(spark, sf):
    """A present missing value stays missing in a filled wide table; only absent cells are filled."""
    rows = _daily_with_gaps(spark, sf).withColumn("year", F.year("dt"))
    yearly = rows.where(F.col("status") != "F").groupBy("fund", "year").agg(F.max("inflow").alias("inflow"))
    columns = {f"y{y}": y for y in range(t.FIRST, t.LAST + 1)}
    return rounded(reshape.wide(yearly, ["fund"], "year", "inflow", columns, fill=0.0, others=True), 2)


@query
def monthly_flow(spark, sf):
    table = flows.monthly_flow(_daily_with_gaps(spark, sf), t.classes(spark, sf), *YEARS)
    return rounded(table.orderBy("month"), CENTS_OF_BILLIONS)


@query
def rolling12_flow(spark, sf):
    monthly = flows.monthly_net_by_type(t.daily(spark, sf), t.classes(spark, sf), *YEARS)
    return rounded(flows.rolling_flow(monthly), CENTS_OF_BILLIONS)


@query
def cum_flow_total(spark, sf):
    monthly = flows.monthly_flow(t.daily(spark, sf), t.classes(spark, sf), *YEARS)
    return rounded(flows.cumulative_flow(monthly).select("month", "net", "net_cum"), CENTS_OF_BILLIONS)


@query
def cum_flow_by_type(spark, sf):
    monthly = flows.monthly_net_by_type(t.daily(spark, sf), t.classes(spark, sf), *YEARS)
    return rounded(flows.cumulative_flow(monthly, ["type"]), CENTS_OF_BILLIONS)


# Balances


@query
def custody_sum_by_type(spark, sf):
    table = balances.custody_sum(t.daily(spark, sf), t.classes(spark, sf), *t.QUARTERS)
    return rounded(table, CENTS_OF_BILLIONS)


@query
def custody_sum_fanout(spark, sf):
    weights = base.with_policy(t.snapshots_with_gaps(spark, sf))
    lumped = profile.lump_types(t.classes(spark, sf), t.OPEN_TYPES)
    table = balances.custody_sum(
        t.daily(spark, sf), lumped, *t.QUARTERS, weights, missing.strict_sum, labelled=False
    )
    return rounded(table, CENTS_OF_BILLIONS)


def _fund_years(spark, sf):
    moment = periods.dated_sequence(F.col("dt"), F.col("seq"))
    return balances.fund_years(t.daily(spark, sf).withColumn("moment", moment), *YEARS, ["moment"])


@query
def latest_row_per_fund_year(spark, sf):
    return rounded(_fund_years(spark, sf), CENTS_OF_BILLIONS)


@query
def year_end_balance(spark, sf):
    return rounded(balances.year_end_balance(_fund_years(spark, sf), t.classes(spark, sf)), CENTS_OF_BILLIONS)


@query
def year_end_balance_wide(spark, sf):
    columns = {name.lower(): name for name in t.TYPES}
    table = balances.year_end_balance_wide(_fund_years(spark, sf), t.classes(spark, sf), columns)
    return rounded(table, CENTS_OF_BILLIONS)


@query
def balance_reconciliation(spark, sf):
    return rounded(balances.reconciliation(_fund_years(spark, sf), t.classes(spark, sf)), CENTS_OF_BILLIONS)


def _repeated_classes(spark, sf):
    """Every third fund has its class row twice, every fourth a second type that is folded into the rest."""
    rows = t.classes(spark, sf)
    twice = rows.where(F.col("fund") % 3 == 0)
    other = rows.where(F.col("fund") % 4 == 0).withColumn("type", F.lit("FURNITURE"))
    return profile.lump_types(rows.unionByName(twice).unionByName(other), t.OPEN_TYPES)


@query
def balance_repeated_classes(spark, sf):
    found = balances.year_end_balance(_fund_years(spark, sf), _repeated_classes(spark, sf))
    return rounded(found, CENTS_OF_BILLIONS)


@query
def reconciliation_repeated_classes(spark, sf):
    found = balances.reconciliation(_fund_years(spark, sf), _repeated_classes(spark, sf))
    return rounded(found, CENTS_OF_BILLIONS)


# Returns


def _returns(spark, sf):
    return returns.annual_return(t.dense_daily(spark, sf), *YEARS, t.DENSE_ORDER)


def _quotas_with_gaps(spark, sf):
    return t.dense_daily(spark, sf).withColumn("quota", F.when(F.col("flag") != "R", F.col("quota")))


@query
def annual_return(spark, sf):
    return rounded(_returns(spark, sf), 6)


@query
def annual_return_missing(spark, sf):
    return rounded(returns.annual_return(_quotas_with_gaps(spark, sf), *YEARS, t.DENSE_ORDER), 6)


@query
def annual_return_nonnull(spark, sf):
    found = returns.annual_return(_quotas_with_gaps(spark, sf), *YEARS, t.DENSE_ORDER, skip_missing=True)
    return rounded(returns.plausible(found), 6)


@query
def returns_repeated_classes(spark, sf):
    moment = periods.dated_sequence(F.col("dt"), F.col("seq"))
    found = returns.annual_return(t.daily(spark, sf).withColumn("moment", moment), *YEARS, ["moment"])
    benchmark = returns.rate_by_year(t.rates(spark, sf), *YEARS, strict=True)
    return rounded(returns.with_type_and_benchmark(found, _repeated_classes(spark, sf), benchmark), 6)


@query
def rate_compound(spark, sf):
    return rounded(returns.rate_by_year(t.rates(spark, sf), *YEARS, strict=True), 6)


@query
def rate_compound_skipping(spark, sf):
    gaps = t.rates(spark, sf).withColumn("rate_pct", F.when(F.month("dt") != 5, F.col("rate_pct")))
    skipping = returns.rate_by_year(gaps, *YEARS).withColumnRenamed("benchmark", "skipping")
    strict = returns.rate_by_year(gaps, *YEARS, strict=True).withColumnRenamed("benchmark", "strict")
    return rounded(joins.calendar_join(skipping, strict), 6)


@query
def rate_running(spark, sf):
    return rounded(returns.rate_running(t.rates(spark, sf)).select("dt", "running"), 6)


BAD_CLOSE = dt.date(1998, 1, 1)


@query
def index_annual_return(spark, sf):
    return rounded(returns.index_by_year(t.closes(spark, sf), *YEARS, BAD_CLOSE), 6)


def _with_benchmark(spark, sf):
    benchmark = returns.rate_by_year(t.rates(spark, sf), *YEARS, strict=True)
    return returns.with_type_and_benchmark(_returns(spark, sf), t.dense_classes(spark, sf), benchmark)


@query
def return_vs_benchmark(spark, sf):
    return rounded(_with_benchmark(spark, sf), 6)


@query
def return_vs_index(spark, sf):
    index = returns.index_by_year(t.closes(spark, sf), *YEARS, BAD_CLOSE)
    return rounded(returns.with_type_and_benchmark(_returns(spark, sf), t.dense_classes(spark, sf), index), 6)


@query
def outlier_funds(spark, sf):
    return returns.outlier_funds(_returns(spark, sf), 500)


def _kept(spark, sf, limit=500):
    return returns.without_outlier_funds(_with_benchmark(spark, sf), limit)


@query
def return_outlier_excluded(spark, sf):
    return rounded(_kept(spark, sf), 6)


@query
def return_outlier_excluded_200(spark, sf):
    return rounded(_kept(spark, sf, 200).select("fund", "year", "ret"), 6)


FIRST_FACETS = ["AFRICA", "ASIA", "EUROPE"]


@query
def return_quartiles(spark, sf):
    marked = returns.mark_outlier_funds(staged(_with_benchmark(spark, sf), "returns"), 500)
    return rounded(distributions.return_quartiles(marked.where(F.col("type").isin(FIRST_FACETS))), 6)


@query
def return_quartiles_others(spark, sf):
    marked = returns.mark_outlier_funds(staged(_with_benchmark(spark, sf), "returns"), 500)
    return rounded(distributions.return_quartiles(marked.where(missing.not_in(F.col("type"), FIRST_FACETS))), 6)


@query
def quartiles_by_selection(spark, sf):
    """Exact quartiles by the method meant for groups too large for one task."""
    prices = t.dense_daily(spark, sf).select("flag", "quota")
    found = distribution.group_stats(prices, ["flag"], "quota", distribution.QUARTILES, "select")
    return rounded(found.select("flag", "n", "low", *distribution.QUARTILES, "high"), 6)


@query
def return_boxplot(spark, sf):
    trimmed = _trimmed(spark, sf)
    benchmark = returns.rate_by_year(t.rates(spark, sf), *YEARS)
    return rounded(distributions.return_boxes(trimmed, benchmark), 6)


@query
def return_density(spark, sf):
    kept = staged(_kept(spark, sf).select("type", "year", "ret"), "kept")
    curve = distribution.density_curve(kept, distributions.FACET, "ret", method="builtin")
    return rounded(rounded(curve, 6, "at", "bandwidth"), 10, "density")


@query
def price_density_binned(spark, sf):
    """Density of all daily prices, a few groups of many rows, by linear binning."""
    prices = t.dense_daily(spark, sf).select("flag", "quota")
    curve = distribution.binned_density(prices, ["flag"], "quota")
    return rounded(rounded(curve, 6, "at", "bandwidth"), 10, "density")


def _trimmed(spark, sf):
    quotas = _quotas_with_gaps(spark, sf)
    found = returns.plausible(returns.annual_return(quotas, *YEARS, t.DENSE_ORDER, skip_missing=True))
    typed = staged(joins.lookup_join(found, t.dense_classes(spark, sf), "fund", "inner"), "returns")
    return returns.trimmed_returns(typed, k=4, prefix="MIDDLE")


@query
def iqr_trimmed_returns(spark, sf):
    return rounded(_trimmed(spark, sf), 6)


def _by_nation(spark, sf):
    return joins.lookup_join(_returns(spark, sf), t.dense_classes(spark, sf, by_nation=True), "fund", "inner")


@query
def top5_types(spark, sf):
    return returns.main_types(_by_nation(spark, sf), 5)


@query
def funds_by_type(spark, sf):
    return returns.funds_by_type(_by_nation(spark, sf))


# Sources and sinks


def _order_bounds(spark, sf):
    return t.daily(spark, sf).agg(F.min("dt").alias("first"), F.max("dt").alias("last"))


@query
def month_spine(spark, sf):
    return spines.monthly_spine(_order_bounds(spark, sf))


@query
def year_spine(spark, sf):
    return spines.yearly_spine(_order_bounds(spark, sf))


@query
def union_by_name(spark, sf):
    return delimited.union_by_name(t.vintages(t.raw_daily(spark, sf)))


def _per_year(reports: DataFrame) -> DataFrame:
    sums = [F.count("*").alias("n"), F.count_distinct("fund").alias("funds")]
    sums += [F.sum(c).alias(c) for c in ("quota", "inflow", "outflow")]
    return rounded(reports.groupBy(F.year("dt").alias("year"), "fund_kind").agg(*sums), 2)


def _land(spark, sf, label: str) -> str:
    """Both vintages of the daily reports as CSV files below a fresh folder."""
    folder = scratch_path(spark, label)
    for number, part in enumerate(t.vintages(t.raw_daily(spark, sf))):
        landing.write_csv(part, f"{folder}/csv/{number}")
    return folder


def _with_all_columns(raw: DataFrame) -> DataFrame:
    absent = {n: F.lit(None).cast(k) for n, k in schemas.DAILY_TYPES.items() if n not in raw.columns}
    return raw.withColumns(absent)


@query
def csv_two_vintages(spark, sf):
    folder = _land(spark, sf, "csv")
    raw = delimited.read_delimited(spark, f"{folder}/csv/*", schemas.DAILY_TYPES)
    return _per_year(schemas.daily_reports(_with_all_columns(raw)))


@query
def zip_ingest(spark, sf):
    folder = _land(spark, sf, "zip")
    for number in range(2):
        landing.zip_files(spark, f"{folder}/csv/{number}", f"{folder}/zip")
    raw = archives.read_archives(spark, f"{folder}/zip", schemas.DAILY_TYPES)
    return _per_year(schemas.daily_reports(_with_all_columns(raw)))


@query
def ingest_consolidated(spark, sf):
    """Archives of the old vintage and text files of the new one, consolidated and read back."""
    folder = _land(spark, sf, "ingest")
    landing.zip_files(spark, f"{folder}/csv/0", f"{folder}/landed")
    landing.write_csv(t.vintages(t.raw_daily(spark, sf))[1], f"{folder}/landed/new")
    old = ingest.landed_reports(spark, f"{folder}/landed", files=None)
    new = ingest.landed_reports(spark, f"{folder}/landed/new", archives=None)
    ingest.consolidate(delimited.union_by_name([old, new]), f"{folder}/daily")
    return _per_year(spark.read.parquet(f"{folder}/daily"))


@query
def ingest_problems(spark, sf):
    """Text files that begin with blank lines, and archives, with numbers and rows that can't be read: their lines."""
    folder = scratch_path(spark, "problems")
    old, new = t.vintages(t.raw_daily(spark, sf))
    odd = F.when(F.dayofmonth("DT_COMPTC") == 3, F.concat(F.floor("VL_QUOTA"), F.lit(",5"))).otherwise(F.floor("VL_QUOTA").cast("string"))
    surplus = F.when(F.dayofmonth("DT_COMPTC") == 4, ";1;2").otherwise("")
    for number, part in enumerate((old, new)):
        whole = {c: F.floor(c).cast("string") for c in ("VL_PATRIM_LIQ", "CAPTC_DIA")}
        part = part.withColumns({**whole, "VL_QUOTA": odd, "RESG_DIA": F.concat(F.floor("RESG_DIA").cast("string"), surplus)})
        lines = part.select(F.concat_ws(";", *[F.col(c).cast("string") for c in part.columns]).alias("line"))
        landing.write_lines(lines, ";".join(part.columns), f"{folder}/csv/{number}", blank_lines=2)
    landing.zip_files(spark, f"{folder}/csv/0", f"{folder}/landed")
    found = [
        ingest.problem_lines(spark, f"{folder}/landed", files=None).withColumn("archived", F.lit(True)),
        ingest.problem_lines(spark, f"{folder}/csv/1", archives=None).withColumn("archived", F.lit(False)),
    ]
    kept = ingest.landed_reports(spark, f"{folder}/csv/1", archives=None).agg(
        F.lit("rows kept").alias("line"), F.count("*").alias("n"), F.count("quota").alias("quotas")
    )
    lines = found[0].union(found[1]).groupBy("line", "archived").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("quotas"))
    return lines.unionByName(kept.withColumn("archived", F.lit(False)))


@query
def csv_quoted_breaks(spark, sf):
    """Texts with their line breaks in quoted fields of files and archives; without quoting each line is a row."""
    folder = scratch_path(spark, "breaks")
    texts = t.table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", '[\r\t"]', " ").alias("text"))
    lines = texts.select(F.concat(F.col("doc_id"), F.lit(';"'), "text", F.lit('";'), "lang").alias("line"))
    landing.write_lines(lines, "doc_id;text;lang", f"{folder}/csv")
    landing.zip_files(spark, f"{folder}/csv", f"{folder}/zip")
    types = {"doc_id": "bigint"}
    found = [
        delimited.read_delimited(spark, f"{folder}/csv", types).withColumn("mode", F.lit("files")),
        archives.read_archives(spark, f"{folder}/zip", types).withColumn("mode", F.lit("archives")),
    ]
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    whole = [x.select("mode", "doc_id", "lang", breaks.cast("bigint").alias("n"), F.md5("text").alias("digest")) for x in found]
    apart = delimited.read_delimited(spark, f"{folder}/csv", types, quote="")
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("doc_id", "bigint"), ("lang", "string"))]
    counted = apart.agg(F.count("*").alias("n")).select(F.lit("unquoted").alias("mode"), *nothing, "n", F.lit(None).cast("string").alias("digest"))
    return whole[0].union(whole[1]).union(counted)


@query
def csv_codepage_roundtrip(spark, sf):
    """Every character that the code page and the separated format can hold goes there and back."""
    plain = F.trim(F.regexp_replace("text", f"[^ -:<-~\u00a0-\u00ff{delimited.CP1252_PRINTABLE}]", " "))
    coded = t.table(spark, sf, "documents").select("doc_id", "lang", F.concat(plain, F.lit(" €–”")).alias("text"))
    folder = scratch_path(spark, "codepage")
    landing.write_cp1252(coded, f"{folder}/csv")
    back = delimited.read_delimited(
        spark, f"{folder}/csv", {"doc_id": "bigint"}, quote="", encoding="windows-1252"
    )
    return back.select("doc_id", "lang", F.length("text").cast("bigint").alias("length"), F.md5("text").alias("digest"))


@query
def table_write_modes(spark, sf):
    """Create, a refused second create, and a restated last year with doubled inflow."""
    folder = scratch_path(spark, "modes")
    rows = t.daily(spark, sf).withColumn("year", F.year("dt"))
    store.write_table(rows, folder, "create", "year")
    try:
        store.write_table(rows, folder, "create", "year")
        refused = False
    except AnalysisException:
        refused = True
    restated = rows.where(F.col("year") == t.LAST).withColumn("inflow", F.col("inflow") * 2)
    store.write_table(restated, folder, "restate", "year", covers=["dt"])
    back = spark.read.parquet(folder).groupBy("year").agg(F.count("*").alias("n"), F.sum("inflow").alias("inflow"))
    return rounded(back, 2).withColumn("refused", F.lit(refused))


@query
def table_overwrite(spark, sf):
    """A full overwrite: what the table held before is gone."""
    folder = scratch_path(spark, "overwrite")
    rows = t.daily(spark, sf).withColumn("year", F.year("dt"))
    store.write_table(rows, folder, "create", "year")
    store.write_table(rows.where(F.col("status") == "F"), folder, "replace", "year")
    back = spark.read.parquet(folder).groupBy("year").agg(F.count("*").alias("n"), F.sum("outflow").alias("outflow"))
    return rounded(back, 2)


@query
def restate_month(spark, sf):
    """All daily rows consolidated; one month published again with doubled inflow; a part of a month refused."""
    folder = scratch_path(spark, "restate")
    rows = t.daily(spark, sf)
    ingest.consolidate(rows, folder)
    month = rows.where(periods.in_years(F.col("dt"), 1997, 1997) & (F.month("dt") == 3))
    ingest.consolidate(month.withColumn("inflow", F.col("inflow") * 2), folder, "restate")
    try:
        ingest.consolidate(month.where(F.dayofmonth("dt") > 9), folder, "restate")
        refused = False
    except ValueError:
        refused = True
    back = spark.read.parquet(folder)
    sums = [F.count("*").alias("n"), F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow")]
    found = back.groupBy(F.trunc("dt", "MM").alias("month")).agg(*sums)
    return rounded(found, 2).withColumn("refused", F.lit(refused))


@query
def active_funds_any_period(spark, sf):
    """Different funds per type of each year and of periods across years, all from the same bitmaps by month."""
    daily = t.daily(spark, sf)
    bitmaps = active.month_bitmaps(daily, t.classes(spark, sf), active.fund_numbers(daily))
    periods_asked = [(dt.date(1996, 11, 5), dt.date(1997, 2, 1)), (dt.date(1995, 1, 1), dt.date(2001, 12, 31)), (dt.date(1998, 3, 1), dt.date(1998, 3, 31))]
    found = [active.active_by_year(bitmaps).select(F.col("year").cast("string").alias("period"), "type", "n")]
    for first, last in periods_asked:
        for by_type in (True, False):
            one = active.active_funds(bitmaps, first, last, by_type).withColumn("period", F.lit(f"{first:%Y-%m}..{last:%Y-%m}"))
            found.append(one.select("period", "type" if by_type else F.lit("all").alias("type"), "n"))
    return delimited.union_by_name(found)


@query
def running_total_by_ranges(spark, sf):
    """Running inflow over all daily rows in order of time, and the number of each fund, without a single task."""
    rows = t.daily(spark, sf).select("fund", "dt", "seq", "inflow")
    totals = prefix.running_total(rows, "inflow", ["dt", "seq"], "total")
    return rounded(prefix.level_numbers(totals, "fund", "fund_number"), 2)


@query
def merge_published_again(spark, sf):
    """One month published again for some funds, by every rule: the others kept or ended, undated rows added or refused."""
    rows = t.daily(spark, sf).withColumn("dt", F.when(F.col("seq") % 97 != 0, F.col("dt")))
    month = rows.where(periods.in_years(F.col("dt"), 1997, 1997) & (F.month("dt") == 3) & (F.col("fund") % 3 != 0))
    again = month.withColumn("inflow", F.col("inflow") * 2)
    undated = rows.where(F.col("dt").isNull() & (F.col("fund") % 2 == 0))
    late = undated.withColumn("inflow", F.lit(1.0)).where(F.col("fund") % 4 == 0)
    mixed = again.unionByName(undated).unionByName(late)
    rules = {"kept": [again], "ended": [again], "undated": [mixed, mixed], "refused": [mixed]}  # a second run changes nothing
    options = {"ended": {"absent": "end"}, "undated": {"undated": "add"}}
    start = scratch_path(spark, "merge")
    ingest.consolidate(rows, start)
    found = []
    for rule, batches in rules.items():
        folder = scratch_path(spark, f"merge-{rule}")
        ingest.consolidate(spark.read.parquet(start), folder)
        refused = False
        for batch in batches:
            try:
                ingest.consolidate(batch, folder, "merge", **options.get(rule, {}))
            except ValueError:
                refused = True
        sums = [F.count("*").alias("n"), F.countDistinct("fund").alias("funds"), F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow")]
        back = spark.read.parquet(folder).groupBy(F.trunc("dt", "MM").alias("month")).agg(*sums)
        found.append(rounded(back, 2).withColumns({"rule": F.lit(rule), "refused": F.lit(refused)}))
    return delimited.union_by_name(found)


@query
def upkeep_of_partials(spark, sf):
    """Stored month and year sums after a month was published again and another deleted, without a full recomputation."""
    folder, store_folder = (scratch_path(spark, n) for n in ("upkeep-daily", "upkeep-store"))
    rows = t.daily(spark, sf)
    ingest.consolidate(rows, folder)
    order = ["dt", "seq"]
    upkeep.refresh(spark, folder, store_folder, order)
    again = rows.where(periods.in_years(F.col("dt"), 1997, 1997) & (F.month("dt") == 3) & (F.col("fund") % 3 != 0))
    ingest.consolidate(again.withColumns({c: F.col(c) * 2 for c in ("quota", "inflow")}), folder, "merge")
    store.drop_partitions(spark, folder, [(1999, 5)], [base.YEAR_PARTITION, base.MONTH_PARTITION])
    changed = upkeep.refresh(spark, folder, store_folder, order)
    months, years = upkeep.months(spark, store_folder), upkeep.years(spark, store_folder)
    by_month = months.groupBy("dt").agg(F.sum("rows").alias("n"), F.sum("inflow").alias("inflow"), F.sum("net").alias("net"), F.lit(None).cast("double").alias("ret"))
    returned = years.withColumn("ret", F.col("end") - F.col("start"))
    by_year = returned.groupBy(F.make_date("year", F.lit(1), F.lit(1)).alias("dt")).agg(
        F.count("*").alias("n"), F.sum("balance").alias("inflow"), F.sum("net").alias("net"), F.sum("ret").alias("ret")
    )
    both = by_month.withColumn("table", F.lit("months")).unionByName(by_year.withColumn("table", F.lit("years")))
    told = F.lit(",".join(f"{y}-{m}" for y, m in changed))
    return rounded(both, 2).withColumn("changed", told)


def _published(spark, sf, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` in library names, written under the published names in a text file and read back from it."""
    folder = scratch_path(spark, "published")
    absent = {short: F.lit(None).cast("string") for short in columns.values() if short not in rows.columns}
    rows = rows.withColumns(absent)
    landing.write_csv(rows.select(*[F.col(short).alias(name) for name, short in columns.items()]), folder)
    return delimited.read_delimited(spark, folder, {})


@query
def classes_published(spark, sf):
    rows = t.classes_by_text_id(spark, sf).withColumn("minimum_deposit", F.col("fund").cast("bigint") * 100)
    found = schemas.classes(_published(spark, sf, rows, schemas.CLASS_COLUMNS))
    return found.select("fund", "category", "type", "investor", "feature", "structure", "minimum_deposit", "name")


@query
def snapshots_published(spark, sf):
    rows = t.snapshots(spark, sf).withColumn("fund", t.punctuated_id(F.col("fund")))
    found = schemas.snapshots(_published(spark, sf, rows, schemas.SNAPSHOT_COLUMNS))
    by = ["dt", "fund", "policy", "mirror", "feeder", "entry_fee", "perf_fee", "exit_fee", "audience"]
    return found.groupBy(*by).agg(F.count("*").alias("n"))


@query
def rates_published(spark, sf):
    raw = _published(spark, sf, t.rates(spark, sf), schemas.RATE_COLUMNS)
    rates = schemas.rates(raw.withColumn("4391", F.col("4391").cast("double")))
    return rounded(returns.rate_by_year(rates, *YEARS, strict=True), 6)


@query
def closes_published(spark, sf):
    raw = _published(spark, sf, t.closes(spark, sf), schemas.CLOSE_COLUMNS)
    closes = schemas.closes(raw.withColumn("BVSP.Close", F.col("`BVSP.Close`").cast("double")))
    return rounded(returns.index_by_year(closes, *YEARS, BAD_CLOSE), 6)


# The published studies on the test tables, a key report of each


@query
def study_fixed_income(spark, sf):
    reports = studies.fixed_income(*t.study_tables(spark, sf, "AMERICA", "Renda Fixa"), ("dt", "seq"))
    return rounded(reports["flow_by_type"], CENTS_OF_BILLIONS)


@query
def study_multimarket(spark, sf):
    tables = t.study_tables(spark, sf, "ASIA", "Multimercados")
    reports = studies.multimarket(*tables, ("dt", "seq"), studies.EARLIER_MULTIMARKET_LIMIT)
    return rounded(reports["return_quartiles_1"], 6)


@query
def study_equity(spark, sf):
    daily, classes, snapshots, _ = t.study_tables(spark, sf, "EUROPE", "Ações")
    closes = t.closes(spark, sf).withColumn("dt", t.later(F.col("dt")))
    reports = studies.equity(daily, classes, snapshots, closes, ("dt", "seq"))
    return rounded(reports["custody_by_type"], CENTS_OF_BILLIONS)


@query
def study_multimarket_flows(spark, sf):
    daily, classes, _, rates = t.study_tables(spark, sf, "ASIA", "Multimercados")
    return rounded(studies.multimarket_flows(daily, classes, rates, ("dt", "seq"))["reconciliation"], CENTS_OF_BILLIONS)


# All other reports of a study, from one run of it: a row for each number


def _in_long_form(reports: dict[str, DataFrame], keys: dict[str, list[str]], digits: int = CENTS_OF_BILLIONS) -> DataFrame:
    """(report, key, item, value) of each number of the reports that ``keys`` names with the columns that tell their rows."""
    parts = []
    for name, by in keys.items():
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by])
        numbers = [c for c in reports[name].columns if c not in by]
        items = [F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers]
        row = reports[name].select(F.lit(name).alias("report"), key.alias("key"), F.explode(F.array(*items)).alias("number"))
        parts.append(row.select("report", "key", "number.item", (F.round("number.value", digits) + 0.0).alias("value")))
    return reduce(DataFrame.unionByName, parts)


PROFILE_KEYS = {
    "investor_profile": ["investor", "feature"],
    "latest_structure": ["policy", "mirror", "feeder"],
    "fee_matrix": ["policy", *profile.FEES],
}


@query
def study_fixed_income_reports(spark, sf):
    reports = studies.fixed_income(*t.study_tables(spark, sf, "AMERICA", "Renda Fixa"), ("dt", "seq"))
    shares = _in_long_form(reports, {"type_share": ["category", "type"]}, 6)
    return shares.union(_in_long_form(reports, PROFILE_KEYS | {"quarterly_flow": ["quarter"], "custody_by_type": ["quarter", "type"]}))


@query
def study_multimarket_reports(spark, sf):
    reports = studies.multimarket(*t.study_tables(spark, sf, "ASIA", "Multimercados"), ("dt", "seq"))
    shares = _in_long_form(reports, {"type_share": ["category", "type"]}, 6)
    by_type = {"flow_by_type": ["quarter", "type"], "custody_by_type": ["quarter", "type"]}
    return shares.union(_in_long_form(reports, PROFILE_KEYS | {"quarterly_flow": ["quarter"]} | by_type))


@query
def study_equity_reports(spark, sf):
    daily, classes, snapshots, _ = t.study_tables(spark, sf, "EUROPE", "Ações")
    closes = t.closes(spark, sf).withColumn("dt", t.later(F.col("dt")))
    reports = studies.equity(daily, classes, snapshots, closes, ("dt", "seq"))
    in_percent = _in_long_form(reports, {"type_share": ["category", "type"], "return_quartiles_1": ["type", "year"]}, 6)
    return in_percent.union(_in_long_form(reports, PROFILE_KEYS | {"quarterly_flow": ["quarter"], "flow_by_type": ["quarter", "type"]}))


@query
def study_multimarket_flows_reports(spark, sf):
    daily, classes, _, rates = t.study_tables(spark, sf, "ASIA", "Multimercados")
    reports = studies.multimarket_flows(daily, classes, rates, ("dt", "seq"))
    keys = {
        "type_year_counts": ["type"],
        "annual_net_by_type": ["year"],
        "annual_net_by_year": ["type"],
        "monthly_flow": ["month"],
        "rolling_flow": ["month", "type"],
        "cumulative_flow": ["month"],
        "cumulative_flow_by_type": ["month", "type"],
        "year_end_balance": ["year", "dt"],
    }
    return _in_long_form(reports, keys)


# The site's own tables


def _entries(spark, sf):
    ended = F.col("o_orderstatus") != "O"
    return t.table(spark, sf, "orders").select(
        F.when(F.col("o_totalprice") > 200000, "profissional").otherwise("academica").alias("section"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("institution"),
        F.col("o_orderkey").alias("entry"),
        F.when(ended, F.col("o_orderdate").cast("date")).alias("end"),
    )


@query
def job_table(spark, sf):
    return catalog.job_table(_entries(spark, sf))


@query
def catalog_page(spark, sf):
    return catalog.listing_page(t.posts(spark, sf).select("doc_id", "dt"), ["doc_id"], 36, 2)


@query
def catalog_first_page(spark, sf):
    return catalog.listing_page(t.posts(spark, sf).select("doc_id", "dt"), ["doc_id"], 3)


@query
def category_counts(spark, sf):
    return catalog.category_counts(t.posts(spark, sf))


@query
def category_filter(spark, sf):
    return catalog.in_category(t.posts(spark, sf), "fr").select("doc_id", "dt")


@query
def reading_time(spark, sf):
    return catalog.reading_time(t.posts(spark, sf)).select(
        "doc_id", F.col("words").cast("bigint").alias("words"), F.col("minutes").cast("bigint").alias("minutes")
    )
