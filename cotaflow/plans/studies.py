"""The four published studies with their own parameters.

Each takes the tables in library names and returns its reports by name.  The daily rows are read twice, once to
sum them per fund and month and once per fund and year; these tables and the returns are staged, and everything
else is lazy.  Rows that tie on ``order_by`` are told apart by all their other columns, so a study does not depend
on the order in which rows are stored.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.functions.labels import REST
from cotaflow.functions.missing import not_in, skip_sum, strict_sum
from cotaflow.operators.distribution import density_curve
from cotaflow.operators.joins import keep_members, lookup_join
from cotaflow.plans import balances, base, distributions, flows, partials, profile, returns
from cotaflow.sources.scratch import staged

# Categories, types, facets, spans and limits of the studies.
QUARTERS = (2010, 1), (2024, 4)
YEARS = 2010, 2024
FLOW_YEARS = 2015, 2025

FIXED_INCOME_TYPES = [
    "Renda Fixa Duração Livre Crédito Livre",
    "Renda Fixa Duração Livre Grau de Investimento",
    "Renda Fixa Duração Baixa Grau de Investimento",
    "Renda Fixa Duração Livre Soberano",
    "Renda Fixa Duração Baixa Soberano",
    "Renda Fixa Indexados",
    "Renda Fixa Simples",
]
FIXED_INCOME_FACET = [
    "Renda Fixa Duração Livre Crédito Livre",
    "Renda Fixa Duração Livre Grau de Investimento",
    "Renda Fixa Duração Baixa Grau de Investimento",
    "Renda Fixa Duração Livre Soberano",
]
MULTIMARKET_FACETS = [
    [
        "Multimercados Livre",
        "Multimercados Macro",
        "Multimercados Investimento no Exterior",
        "Multimercados Juros e Moedas",
    ],
    [
        "Multimercados Balanceados",
        "Multimercados Dinâmico",
        "Multimercados Trading",
        "Multimercados Capital Protegido",
    ],
    [
        "Multimercados Long and Short - Direcional",
        "Multimercados Long and Short - Neutro",
        "Multimercados Estratégia Específica",
    ],
]
EQUITY_FACETS = [
    ["Ações Dividendos", "Ações Livre", "Ações Indexados", "Ações Small Caps"],
    ["Ações Investimento no Exterior", "Ações Setoriais", "Ações Índice Ativo", "Ações Valor/Crescimento"],
    ["Ações FMP-FGTS", "Fechados de Ações", "Fundos de Mono Ação"],
]
OPEN_TYPES = ["Multimercados Investimento no Exterior", "Multimercados Livre", "Multimercados Macro"]
BAD_CLOSE = dt.date(2012, 1, 2)
FIXED_INCOME_LIMIT, MULTIMARKET_LIMIT, EARLIER_MULTIMARKET_LIMIT, EQUITY_LIMIT = 50, 50, 200, 500
MAIN_TYPES = 5

Reports = dict[str, DataFrame]


def fixed_income(
    daily: DataFrame, classes: DataFrame, snapshots: DataFrame, rates: DataFrame, order_by: tuple[str, ...] = ("dt",)
) -> Reports:
    """Fixed-income funds against the interest rate.  Sums run locally there: a gap makes them missing."""
    chosen = base.study_classes(classes, "Renda Fixa")
    lumped = profile.lump_types(chosen, FIXED_INCOME_TYPES)
    weights = base.with_policy(snapshots)
    months, years = _summed(daily, chosen, *YEARS, list(order_by))
    strict = partials.strict(months)
    reports = _profiles(months, chosen, snapshots)
    reports["quarterly_flow"] = flows.quarterly_flow(strict, chosen, *QUARTERS, weights)
    reports["flow_by_type"] = flows.quarterly_flow_by_type(
        strict, lumped, *QUARTERS, weights, strict_sum, labelled=False
    )
    reports["custody_by_type"] = balances.custody_sum(strict, lumped, *QUARTERS, weights, strict_sum, labelled=False)
    cdi = returns.rate_by_year(rates, *YEARS, strict=True)
    annual = partials.returns_of(years)
    marked = _marked(returns.with_type_and_benchmark(annual, lumped, cdi), FIXED_INCOME_LIMIT)
    in_facet = F.col("type").isin(FIXED_INCOME_FACET)
    reports |= _facets([marked.where(in_facet), marked.where(not_in(F.col("type"), FIXED_INCOME_FACET))])
    return reports


def multimarket(
    daily: DataFrame,
    classes: DataFrame,
    snapshots: DataFrame,
    rates: DataFrame,
    order_by: tuple[str, ...] = ("dt",),
    limit: float = MULTIMARKET_LIMIT,
) -> Reports:
    """Multi-market funds against the interest rate.  An earlier version has ``EARLIER_MULTIMARKET_LIMIT``."""
    cdi = returns.rate_by_year(rates, *YEARS, strict=True)
    return _database_study(
        daily, classes, snapshots, "Multimercados", cdi, limit, MULTIMARKET_FACETS, order_by
    )


def equity(
    daily: DataFrame, classes: DataFrame, snapshots: DataFrame, closes: DataFrame, order_by: tuple[str, ...] = ("dt",)
) -> Reports:
    """Equity funds against the share index."""
    index = returns.index_by_year(closes, *YEARS, BAD_CLOSE)
    return _database_study(daily, classes, snapshots, "Ações", index, EQUITY_LIMIT, EQUITY_FACETS, order_by)


def multimarket_flows(
    daily: DataFrame, classes: DataFrame, rates: DataFrame, order_by: tuple[str, ...] = ("dt",)
) -> Reports:
    """A decade of multi-market flows, balances and returns."""
    chosen = base.open_class_rows(classes, "Multimercados")
    lumped = profile.lump_types(chosen, OPEN_TYPES)
    columns = {name: name for name in [*OPEN_TYPES, REST]}
    months, years = _summed(daily, chosen, *FLOW_YEARS, list(order_by), skip_missing=True)
    skipping, netted = partials.skipping(months), partials.netted(months)
    monthly = flows.monthly_flow(skipping, chosen, *FLOW_YEARS)
    monthly_by_type = flows.monthly_net_by_type(netted, lumped, *FLOW_YEARS)
    closing = partials.closing_of(years)
    annual = returns.plausible(partials.returns_of(years))
    typed = lookup_join(annual, lumped.select("fund", "type").distinct(), "fund", "inner")
    typed = staged(typed, "returns")
    trimmed = returns.trimmed_returns(typed, MAIN_TYPES, "Multimercados")
    return {
        "type_year_counts": profile.type_year_counts_wide(months, chosen, *FLOW_YEARS),
        "annual_net_by_type": flows.annual_net_by_type_wide(netted, lumped, columns, *FLOW_YEARS),
        "annual_net_by_year": flows.annual_net_by_year_wide(netted, lumped, *FLOW_YEARS),
        "monthly_flow": monthly,
        "rolling_flow": flows.rolling_flow(monthly_by_type),
        "cumulative_flow": flows.cumulative_flow(monthly),
        "cumulative_flow_by_type": flows.cumulative_flow(monthly_by_type, ["type"]),
        "year_end_balance": balances.year_end_balance_wide(closing, lumped, columns),
        "reconciliation": balances.reconciliation(closing, lumped),
        "returns": trimmed,
        "return_boxes": distributions.return_boxes(trimmed, returns.rate_by_year(rates, *FLOW_YEARS)),
    }


def _summed(
    daily: DataFrame, chosen: DataFrame, first: int, last: int, order_by: list[str], skip_missing: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The chosen funds' months and years, each from one pass over the daily rows."""
    order = partials.total_order(daily, order_by)
    months = base.for_funds(daily, chosen, partials.fund_months)
    years = base.for_funds(daily, chosen, lambda rows: partials.fund_years(rows, first, last, order, skip_missing))
    return staged(months, "fund-months"), staged(years, "fund-years")


def _profiles(daily: DataFrame, chosen: DataFrame, snapshots: DataFrame) -> Reports:
    funds = profile.reporting_funds_of(daily, chosen)
    return {
        "type_share": profile.type_share(daily, chosen),
        "investor_profile": profile.investor_profile(daily, chosen),
        "latest_structure": profile.latest_structure(snapshots, funds, partials.total_order(snapshots, ["dt"])[1:]),
        "fee_matrix": profile.fee_matrix(snapshots, funds),
    }


def _database_study(
    daily: DataFrame,
    classes: DataFrame,
    snapshots: DataFrame,
    category: str,
    benchmark: DataFrame,
    limit: float,
    facets: list[list[str]],
    order_by: tuple[str, ...],
) -> Reports:
    """The two studies whose sums run in the database, which skips gaps, and need a stated policy."""
    chosen = base.study_classes(classes, category)
    weights = base.with_policy(snapshots)
    months, years = _summed(daily, chosen, *YEARS, list(order_by))
    skipping = partials.skipping(months)
    reports = _profiles(months, chosen, snapshots)
    reports["quarterly_flow"] = flows.quarterly_flow(partials.strict(months), chosen, *QUARTERS, weights)
    reports["flow_by_type"] = flows.quarterly_flow_by_type(skipping, chosen, *QUARTERS, weights, skip_sum)
    reports["custody_by_type"] = balances.custody_sum(skipping, chosen, *QUARTERS, weights, skip_sum)
    annual = keep_members(partials.returns_of(years), weights, "fund")
    marked = _marked(returns.with_type_and_benchmark(annual, chosen, benchmark), limit)
    return reports | _facets([marked.where(F.col("type").isin(facet)) for facet in facets])


def _marked(fund_years: DataFrame, limit: float) -> DataFrame:
    return staged(returns.mark_outlier_funds(fund_years, limit), "returns")


def _facets(parts: list[DataFrame]) -> Reports:
    reports = {}
    for number, part in enumerate(parts, 1):
        reports[f"return_quartiles_{number}"] = distributions.return_quartiles(part)
        kept = part.where(~F.col("is_out"))
        # Facets of fund-years hold one value for each fund, so the built-in percentile serves, in one lazy plan.
        reports[f"return_density_{number}"] = density_curve(kept, distributions.FACET, "ret", method="builtin")
    return reports
