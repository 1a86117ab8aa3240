"""SQL twins of the registered queries, for an independent engine on the same tables.

They are written straight from the meaning of each analysis: joins stay joins, the latest row comes
from a row number, and a snapshot join really repeats its rows.
"""

from __future__ import annotations

ROLES = {
    "D": """SELECT o_custkey AS fund, CAST(o_orderdate AS DATE) AS dt, o_orderkey AS seq,
        o_totalprice AS quota, o_totalprice AS balance,
        CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0.0 END AS inflow,
        CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS outflow,
        o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
    "DG": """SELECT * REPLACE (CASE WHEN status <> 'P' THEN inflow END AS inflow) FROM D""",
    "DL": """SELECT l_suppkey AS fund, CAST(l_shipdate AS DATE) AS dt, l_orderkey * 1000 + l_linenumber AS k1,
        l_partkey AS k2, l_extendedprice AS quota, l_returnflag AS flag,
        CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem""",
    "DLG": """SELECT * REPLACE (CASE WHEN flag <> 'R' THEN quota END AS quota) FROM DL""",
    "C": """SELECT c_custkey AS fund, r_name AS category, c_mktsegment AS type,
        CASE WHEN c_acctbal < 2500 THEN 'Geral' WHEN c_acctbal < 6000 THEN 'Qualificado'
             ELSE 'Profissional' END AS investor,
        CASE c_custkey % 3 WHEN 0 THEN 'Exclusivo' WHEN 1 THEN 'Reservado' ELSE 'Sem restricao' END AS feature,
        CASE WHEN c_acctbal < 0 THEN 'Subclasse' ELSE 'Classe' END AS structure
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "CO": """SELECT * REPLACE (CASE WHEN type IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN type
        ELSE 'Outros' END AS type) FROM C""",
    "CL": """SELECT s_suppkey AS fund, r_name AS type, n_name AS nation FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "X": """SELECT o_custkey AS fund, CAST(o_orderdate AS DATE) AS dt, o_orderkey AS seq, o_orderpriority AS policy,
        CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 'N' ELSE 'S' END AS mirror,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'S' END AS feeder,
        CASE WHEN o_orderkey % 11 = 0 THEN 'S' ELSE 'N' END AS entry_fee,
        CASE WHEN o_totalprice > 200000 THEN 'S' ELSE 'N' END AS perf_fee,
        CASE WHEN o_orderkey % 7 = 0 THEN 'S' ELSE 'N' END AS exit_fee FROM orders""",
    "XG": """SELECT * REPLACE (nullif(policy, '5-LOW') AS policy) FROM X""",
    "M": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, avg(l_discount) * 10 AS rate_pct
        FROM lineitem GROUP BY 1""",
    "I": """SELECT CAST(l_shipdate AS DATE) AS dt, max(l_extendedprice) AS close FROM lineitem GROUP BY 1""",
    "T": """SELECT doc_id, text, [lang, source] AS categories, lang, source,
        DATE '2024-01-01' + CAST(doc_id % 730 AS INTEGER) AS dt FROM documents""",
    # Class rows repeated: every third fund twice, every fourth with a second type.
    "CR": """SELECT * FROM CO UNION ALL SELECT * FROM CO WHERE fund % 3 = 0
        UNION ALL SELECT * REPLACE ('Outros' AS type) FROM CO WHERE fund % 4 = 0""",
    # The studies' years lie 20 years later.
    "SD": """SELECT * REPLACE (CAST(dt + INTERVAL 20 YEAR AS DATE) AS dt, year + 20 AS year) FROM DG""",
    "SX": """SELECT fund, count(*) AS weight FROM XG WHERE policy IS NOT NULL GROUP BY fund""",
    # Fund-years of the dense reports, with type and compounded rate.
    "RY": """SELECT fund, year, (last(quota ORDER BY dt, k1, k2) / first(quota ORDER BY dt, k1, k2) - 1) * 100 AS ret
        FROM DL GROUP BY fund, year""",
    "RATE": """SELECT CAST(year(dt) AS INTEGER) AS year, (product(1 + rate_pct / 100) - 1) * 100 AS benchmark
        FROM M GROUP BY 1""",
    "RT": """SELECT fund, year, ret, type, benchmark FROM RY LEFT JOIN CL USING (fund) LEFT JOIN RATE USING (year)""",
    "KEPT": """SELECT * FROM RT WHERE fund NOT IN (SELECT fund FROM RT WHERE ret > 500 OR ret < -500)""",
    "INDEXED": """SELECT CAST(year(dt) AS INTEGER) AS year,
        (last(close ORDER BY dt) / first(close ORDER BY dt) - 1) * 100 AS benchmark
        FROM I WHERE dt <> DATE '1998-01-01' GROUP BY 1""",
    # Closing row of each fund and year.
    "CLOSING": """SELECT fund, year, balance / 1e9 AS balance, dt FROM (
        SELECT *, row_number() OVER (PARTITION BY fund, year ORDER BY dt DESC, seq DESC) AS rn FROM D) WHERE rn = 1""",
    "MONTHLY": """SELECT CAST(date_trunc('month', dt) AS DATE) AS month, type,
        sum(inflow - outflow) / 1e9 AS net FROM D JOIN C USING (fund) GROUP BY 1, 2""",
    "TRIMBASE": """SELECT fund, year, ret, type FROM (
        SELECT fund, year, (arg_max(quota, ROW(dt, k1, k2)) / arg_min(quota, ROW(dt, k1, k2)) - 1) * 100 AS ret
        FROM DLG GROUP BY fund, year) JOIN CL USING (fund) WHERE ret > -100 AND ret < 300""",
    "TRIM4": """SELECT type FROM TRIMBASE GROUP BY type ORDER BY count(DISTINCT fund) DESC, type LIMIT 4""",
    "TRIMMED": """SELECT *, CASE WHEN starts_with(type, 'MIDDLE') THEN regexp_replace(type, '^MIDDLE\\s+', '')
            ELSE type END AS type_short
        FROM (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (
            SELECT *, quantile_cont(ret, 0.25) OVER (PARTITION BY type, year) AS q1,
                quantile_cont(ret, 0.75) OVER (PARTITION BY type, year) AS q3
            FROM TRIMBASE WHERE type IN (SELECT type FROM TRIM4)))
        WHERE ret BETWEEN lower AND upper""",
}

# Which roles a role builds on.
NEEDS = {
    "DG": ["D"],
    "DLG": ["DL"],
    "CO": ["C"],
    "XG": ["X"],
    "CR": ["CO"],
    "SD": ["DG"],
    "SX": ["XG"],
    "RY": ["DL"],
    "RATE": ["M"],
    "RT": ["RY", "CL", "RATE"],
    "KEPT": ["RT"],
    "INDEXED": ["I"],
    "CLOSING": ["D"],
    "MONTHLY": ["D", "C"],
    "TRIMBASE": ["DLG", "CL"],
    "TRIM4": ["TRIMBASE"],
    "TRIMMED": ["TRIMBASE", "TRIM4"],
}


def with_roles(roles: str, body: str) -> str:
    """``body`` preceded by the named roles and those they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in roles.split():
        add(name)
    defined = ",\n".join(f"{name} AS ({ROLES[name]})" for name in ordered)
    return f"WITH {defined}\n{body}" if ordered else body


ORACLES: dict[str, str] = {}


def oracle(name: str, roles: str, body: str) -> None:
    ORACLES[name] = with_roles(roles, body)


QUARTER_LABEL = "year(dt) || ' T' || quarter(dt)"
QUARTER_START = "CAST(date_trunc('quarter', dt) AS DATE)"

oracle(
    "base_left_then_filter",
    "D C",
    """SELECT lpad(CAST(D.fund AS VARCHAR), 14, '0') AS fund,
        CASE WHEN dt < DATE '1998-01-01' THEN 'FI' ELSE 'CLASSES - FIF' END AS fund_kind,
        dt, quota, balance, inflow, outflow, category, type
    FROM D LEFT JOIN (SELECT * FROM C WHERE fund <> 7) C ON D.fund = C.fund WHERE category = 'AMERICA'""",
)
oracle(
    "base_open_classes",
    "D C",
    """SELECT type, round(coalesce(sum(inflow), 0), 2) AS inflow, count(*) AS rows
    FROM D JOIN C USING (fund)
    WHERE category = 'ASIA' AND fund NOT IN (1, 2, 3, 4, 5) AND nullif(type, 'FURNITURE') IS NOT NULL
        AND type <> 'Outros' AND structure = 'Classe' GROUP BY type""",
)
oracle(
    "semi_join_class",
    "D C",
    """SELECT fund, dt, seq, quota FROM D
    WHERE EXISTS (SELECT 1 FROM C WHERE C.fund = D.fund AND C.category = 'EUROPE')""",
)
LOST = """L AS (SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS fund, o_totalprice AS quota
    FROM orders)"""
ORACLES["semi_join_null_keys"] = f"""WITH {LOST}
SELECT fund, count(*) AS n FROM L
WHERE EXISTS (SELECT 1 FROM L B WHERE B.quota > 490000 AND B.fund IS NOT DISTINCT FROM L.fund) GROUP BY fund"""
ORACLES["anti_join_outliers"] = f"""WITH {LOST}
SELECT fund, count(*) AS n FROM L
WHERE NOT EXISTS (SELECT 1 FROM L B WHERE B.quota > 450000 AND B.fund = L.fund) GROUP BY fund"""
ORACLES["not_in_lists"] = """WITH L AS (SELECT nullif(o_orderpriority, '3-MEDIUM') AS p FROM orders)
SELECT count(*) FILTER (WHERE p IS NULL OR p NOT IN ('1-URGENT', '2-HIGH')) AS missing_kept,
    count(*) FILTER (WHERE p NOT IN ('1-URGENT', '2-HIGH')) AS missing_dropped,
    count(*) FILTER (WHERE p IN ('1-URGENT', '2-HIGH')) AS listed FROM L"""
oracle(
    "snapshot_fanout_sum",
    "D C XG",
    """SELECT type, round(sum(inflow), 2) AS inflow FROM D JOIN C USING (fund) LEFT JOIN XG ON D.fund = XG.fund
    WHERE policy IS NOT NULL GROUP BY type""",
)
oracle(
    "snapshot_latest_sum",
    "D C XG",
    """SELECT type, round(sum(inflow), 2) AS inflow FROM D JOIN C USING (fund)
    WHERE fund IN (SELECT fund FROM XG WHERE policy IS NOT NULL) GROUP BY type""",
)
oracle(
    "snapshot_latest_join",
    "D X",
    """SELECT D.fund, D.seq, D.quota, S.policy, S.perf_fee FROM D LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY fund ORDER BY dt DESC, seq DESC) AS rn FROM X) S
    ON S.fund = D.fund AND S.rn = 1""",
)

ORACLES["clean_id_digits"] = """SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS id FROM customer"""
ORACLES["clean_id_charset"] = """WITH P AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS id
    FROM customer)
SELECT c_custkey, id, substr(id, 1, 2) || '.' || substr(id, 3, 3) || '.' || substr(id, 6, 3) || '/' ||
    substr(id, 9, 4) || '-' || substr(id, 13, 2) AS marked FROM P"""
ORACLES["name_parts"] = """SELECT p_partkey,
    CASE WHEN starts_with(p_name, 'small') THEN regexp_replace(p_name, '^small\\s+', '') ELSE p_name END AS short,
    coalesce(p_brand, 'NA') || '-' || coalesce(nullif(p_type, 'ECONOMY'), 'NA') || '-' || p_size AS pasted,
    p_brand || '-' || coalesce(nullif(p_type, 'ECONOMY'), p_name) AS label,
    p_brand || nullif(p_type, 'ECONOMY') AS joined FROM part"""
oracle(
    "flag_labels",
    "X",
    """SELECT CASE WHEN mirror = 'S' THEN 'Sim' ELSE 'Não' END AS mirror,
        CASE WHEN feeder = 'N' THEN 'Não' ELSE 'Sim' END AS feeder,
        CASE coalesce(mirror, '?') WHEN 'S' THEN 'Sim' WHEN 'N' THEN 'Não' ELSE '?' END AS fee,
        CASE WHEN policy = '1-URGENT' THEN policy ELSE 'Outros' END AS policy, count(*) AS n
    FROM X GROUP BY 1, 2, 3, 4""",
)
oracle(
    "period_labels",
    "D",
    f"""SELECT dt, count(*) AS n, CAST(year(dt) AS INTEGER) AS year, {QUARTER_START} AS quarter_start,
        {QUARTER_LABEL} AS quarter_label, CAST(date_trunc('month', dt) AS DATE) AS month_start,
        CAST(strftime(dt, '%m') AS INTEGER) AS month, TRUE AS not_a_number FROM D GROUP BY dt""",
)
SHARE = """S AS (SELECT category, type, count(*) AS n FROM (
        SELECT DISTINCT fund, category, type FROM D JOIN C USING (fund)) GROUP BY category, type),
    P AS (SELECT *, n / sum(n) OVER () * 100 AS share FROM S),
    Q AS (SELECT *, sum(share) OVER (ORDER BY n DESC, category, type ROWS UNBOUNDED PRECEDING) AS share_cum FROM P)"""
ORACLES["type_share"] = (
    with_roles("D C", "") + f", {SHARE} SELECT category, type, n, round(share, 6) AS share, "
    "round(share_cum, 6) AS share_cum FROM Q"
)
ORACLES["format_report"] = (
    with_roles("D C", "")
    + f""", {SHARE} SELECT category, type, format('{{:,}}', n * 1000) AS funds,
    printf('%.2f', share) || '%' AS share, CAST(round_even(share_cum, 0) AS BIGINT) || '%' AS share_cum,
    'R$ ' || printf('%.2f', n / 7) || ' bi' AS amount FROM Q"""
)
oracle(
    "type_share_total",
    "D C",
    """SELECT category, type, grouping(type) = 1 AS is_total, count(*) AS n
    FROM (SELECT DISTINCT fund, category, type FROM D JOIN C USING (fund))
    GROUP BY GROUPING SETS ((category, type), ())""",
)

oracle(
    "investor_profile",
    "D C",
    """SELECT investor, feature, count(*) AS n FROM (SELECT DISTINCT fund, investor, feature FROM D JOIN C USING (fund))
    GROUP BY investor, feature""",
)
oracle(
    "investor_profile_total",
    "D C",
    """SELECT investor, feature, grouping(investor) = 1 AS is_total, count(*) AS n
    FROM (SELECT DISTINCT fund, investor, feature FROM D JOIN C USING (fund))
    GROUP BY GROUPING SETS ((investor, feature), ())""",
)
oracle(
    "latest_structure",
    "D C X",
    """SELECT policy, CASE WHEN mirror = 'S' THEN 'Sim' ELSE 'Não' END AS mirror,
        CASE WHEN feeder = 'N' THEN 'Não' ELSE 'Sim' END AS feeder, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY fund
            ORDER BY CASE WHEN seq % 97 <> 0 THEN dt END DESC NULLS FIRST, seq DESC) AS rn FROM X
        WHERE fund IN (SELECT fund FROM D JOIN C USING (fund) WHERE category IN ('AMERICA', 'ASIA', 'EUROPE')))
    WHERE rn = 1 GROUP BY 1, 2, 3""",
)
oracle(
    "fee_matrix",
    "D C X",
    """SELECT policy, CASE entry_fee WHEN 'S' THEN 'Sim' WHEN 'N' THEN 'Não' ELSE entry_fee END AS entry_fee,
        CASE perf_fee WHEN 'S' THEN 'Sim' WHEN 'N' THEN 'Não' ELSE perf_fee END AS perf_fee,
        CASE exit_fee WHEN 'S' THEN 'Sim' WHEN 'N' THEN 'Não' ELSE exit_fee END AS exit_fee, n
    FROM (SELECT policy, entry_fee, perf_fee, exit_fee, count(*) AS n FROM (
        SELECT DISTINCT dt, fund, policy, entry_fee, perf_fee, exit_fee FROM X
        WHERE fund IN (SELECT fund FROM D JOIN C USING (fund) WHERE category IN ('AFRICA', 'AMERICA')))
        GROUP BY ALL)""",
)
COUNTS = "N AS (SELECT type, year, count(DISTINCT fund) AS n FROM D JOIN C USING (fund) GROUP BY type, year)"
FULL = "F AS (SELECT type, min(n) AS fewest, count(*) AS years FROM N GROUP BY type)"
ALL_YEARS = "(SELECT count(DISTINCT year) FROM N)"
ORACLES["type_year_counts_wide"] = (
    with_roles("D C", "")
    + f", {COUNTS} SELECT type, "
    + ", ".join(f'coalesce(sum(n) FILTER (WHERE year = {y}), 0)::BIGINT AS "{y}"' for y in range(1995, 2002))
    + " FROM N GROUP BY type"
)
for _name, _limit in (("qualified_types", 100), ("qualified_types_strict", 180)):
    ORACLES[_name] = (
        with_roles("D C", "")
        + f", {COUNTS}, {FULL} SELECT type, fewest, years FROM F WHERE years = {ALL_YEARS} AND fewest > {_limit}"
    )
ORACLES["qualified_lumped_counts"] = (
    with_roles("D C", "")
    + f""", {COUNTS}, {FULL}
SELECT CASE WHEN type IN (SELECT type FROM F WHERE years = {ALL_YEARS} AND fewest > 180) THEN type ELSE 'Outros' END
    AS type, count(*) AS n FROM C GROUP BY 1"""
)

for _name, _sum in (
    ("sum_na_propagate", "CASE WHEN count(inflow) = count(*) THEN sum(inflow) END"),
    ("sum_na_skip", "sum(inflow)"),
    ("sum_na_zero", "coalesce(sum(inflow), 0)"),
):
    oracle(_name, "DG", f"SELECT fund, round({_sum}, 2) AS inflow FROM DG GROUP BY fund")


def _quarterly(source: str, quarter: str, extra: str = "") -> str:
    return f"""SELECT {quarter} AS quarter, type, round(sum(inflow) / 1e9, 11) AS inflow,
        round(-sum(outflow) / 1e9, 11) AS outflow, round(sum(inflow) / 1e9 - sum(outflow) / 1e9, 11) AS net
    FROM {source} {extra} GROUP BY 1, 2"""


def _quarterly_cum(source: str) -> str:
    return f"""SELECT quarter, round(inflow, 11) AS inflow, round(outflow, 11) AS outflow, round(net, 11) AS net,
        round(sum(net) OVER (ORDER BY quarter ROWS UNBOUNDED PRECEDING), 11) AS net_cum
    FROM (SELECT {QUARTER_START} AS quarter, sum(inflow) / 1e9 AS inflow, -sum(outflow) / 1e9 AS outflow,
        (sum(inflow) - sum(outflow)) / 1e9 AS net FROM {source} GROUP BY 1)"""


oracle("quarterly_flow_cum", "D C", _quarterly_cum("D JOIN C USING (fund) WHERE category = 'AMERICA'"))
oracle(
    "quarterly_flow_fanout",
    "D C XG",
    _quarterly_cum(
        "(SELECT D.* FROM D JOIN C USING (fund) LEFT JOIN XG ON XG.fund = D.fund "
        "WHERE category = 'AMERICA' AND policy IS NOT NULL)"
    ),
)
oracle(
    "quarterly_net_by_category",
    "D C",
    f"SELECT {QUARTER_START} AS quarter, "
    + ", ".join(
        f"round(sum(inflow - outflow) FILTER (WHERE category = '{name}') / 1e9, 11) AS {name.lower().replace(' ', '_')}"
        for name in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    )
    + " FROM D JOIN C USING (fund) GROUP BY 1",
)
oracle(
    "quarterly_flow_by_type",
    "DG C",
    _quarterly("DG JOIN C USING (fund)", QUARTER_LABEL, f"WHERE {QUARTER_LABEL} BETWEEN '1996 T2' AND '2000 T3'"),
)
oracle(
    "quarterly_flow_by_type_strict",
    "DG C",
    f"""SELECT quarter, type, inflow, outflow, round(inflow + outflow, 11) AS net FROM (
        SELECT {QUARTER_START} AS quarter, type,
            round(CASE WHEN count(inflow) = count(*) THEN sum(inflow) END / 1e9, 11) AS inflow,
            round(-sum(outflow) / 1e9, 11) AS outflow FROM DG JOIN C USING (fund) GROUP BY 1, 2)""",
)
oracle("quarterly_flow_by_type_lumped", "D CO", _quarterly("D JOIN CO USING (fund)", QUARTER_START))
oracle(
    "annual_flow_wide_type",
    "D CO",
    "SELECT CAST(year AS VARCHAR) AS year, "
    + ", ".join(
        f"coalesce(round(sum(inflow - outflow) FILTER (WHERE type = '{name}') / 1e9, 11), 0) AS {name.lower()}"
        for name in ("BUILDING", "HOUSEHOLD", "MACHINERY", "Outros")
    )
    + ", round(sum(inflow - outflow) / 1e9, 11) AS total FROM D JOIN CO USING (fund) GROUP BY D.year",
)
oracle(
    "annual_flow_wide_year",
    "D CO",
    "SELECT type, "
    + ", ".join(
        f'coalesce(round(sum(inflow - outflow) FILTER (WHERE year = {y}) / 1e9, 11), 0) AS "{y}"'
        for y in range(1995, 2004)
    )
    + ", round(sum(inflow - outflow) / 1e9, 11) AS total FROM D JOIN CO USING (fund) GROUP BY type",
)
oracle(
    "wide_keeps_missing",
    "DG",
    "SELECT fund, "
    + ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE year = {y}) = 0 THEN 0.0 "
        f"ELSE round(max(inflow) FILTER (WHERE year = {y}), 2) END AS y{y}"
        for y in range(1995, 2002)
    )
    + " FROM DG WHERE status <> 'F' GROUP BY fund",
)
oracle(
    "monthly_flow",
    "DG C",
    """SELECT CAST(date_trunc('month', dt) AS DATE) AS month, round(coalesce(sum(inflow), 0) / 1e9, 11) AS inflow,
        round(0 - coalesce(sum(outflow), 0) / 1e9, 11) AS outflow,
        round((coalesce(sum(inflow), 0) - coalesce(sum(outflow), 0)) / 1e9, 11) AS net
    FROM DG JOIN C USING (fund) GROUP BY 1""",
)
oracle(
    "rolling12_flow",
    "MONTHLY",
    """SELECT month, type, round(net, 11) AS net, round(rolling, 11) AS net_rolling FROM (
        SELECT *, sum(net) OVER w AS rolling, count(*) OVER w AS n FROM MONTHLY
        WINDOW w AS (PARTITION BY type ORDER BY month ROWS 11 PRECEDING)) WHERE n = 12""",
)
oracle(
    "cum_flow_total",
    "MONTHLY",
    """SELECT month, round(net, 11) AS net,
        round(sum(net) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING), 11) AS net_cum
    FROM (SELECT month, sum(net) AS net FROM MONTHLY GROUP BY month)""",
)
oracle(
    "cum_flow_by_type",
    "MONTHLY",
    """SELECT month, type, round(net, 11) AS net,
        round(sum(net) OVER (PARTITION BY type ORDER BY month ROWS UNBOUNDED PRECEDING), 11) AS net_cum FROM MONTHLY""",
)

oracle(
    "custody_sum_by_type",
    "D C",
    f"""SELECT {QUARTER_LABEL} AS quarter, type, round(sum(balance) / 1e9, 11) AS custody
    FROM D JOIN C USING (fund) GROUP BY 1, 2""",
)
oracle(
    "custody_sum_fanout",
    "D CO XG",
    """SELECT CAST(date_trunc('quarter', D.dt) AS DATE) AS quarter, type, round(sum(balance) / 1e9, 11) AS custody
    FROM D JOIN CO USING (fund) LEFT JOIN XG ON XG.fund = D.fund WHERE policy IS NOT NULL GROUP BY 1, 2""",
)
oracle(
    "latest_row_per_fund_year",
    "CLOSING",
    """SELECT fund, year, round(balance, 11) AS balance, dt, round(net, 11) AS net FROM CLOSING
    JOIN (SELECT fund, year, sum(inflow - outflow) / 1e9 AS net FROM D GROUP BY fund, year) USING (fund, year)""",
)
oracle(
    "year_end_balance",
    "CLOSING C",
    """SELECT year, type, round(sum(balance), 11) AS balance, max(dt) AS dt FROM CLOSING JOIN C USING (fund)
    GROUP BY year, type""",
)
oracle(
    "year_end_balance_wide",
    "CLOSING C",
    "SELECT CAST(year AS VARCHAR) AS year, dt, "
    + ", ".join(
        f"coalesce(round(sum(balance) FILTER (WHERE type = '{name}'), 11), 0) AS {name.lower()}"
        for name in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + """, round(sum(balance), 11) AS total FROM (
        SELECT year, type, sum(balance) AS balance, max(dt) AS dt FROM CLOSING JOIN C USING (fund) GROUP BY year, type)
    GROUP BY year, dt""",
)
oracle(
    "balance_reconciliation",
    "CLOSING C",
    """SELECT CAST(year AS VARCHAR) AS year, dt, round(balance, 11) AS balance, round(net, 11) AS net,
        round(change, 11) AS change, round(change - net, 11) AS implied_return
    FROM (SELECT *, balance - lag(balance) OVER (ORDER BY year) AS change FROM (
        SELECT year, sum(balance) AS balance, max(dt) AS dt FROM CLOSING JOIN C USING (fund) GROUP BY year)
        LEFT JOIN (SELECT year, sum(inflow - outflow) / 1e9 AS net FROM D JOIN C USING (fund) GROUP BY year)
        USING (year))
    WHERE change IS NOT NULL""",
)

oracle(
    "balance_repeated_classes",
    "CLOSING CR",
    """SELECT year, type, round(sum(balance), 11) AS balance, max(dt) AS dt FROM (
        SELECT *, row_number() OVER (PARTITION BY year, fund, type) AS rn FROM CLOSING JOIN CR USING (fund))
    WHERE rn = 1 GROUP BY year, type""",
)
oracle(
    "reconciliation_repeated_classes",
    "CLOSING CR",
    """SELECT CAST(year AS VARCHAR) AS year, dt, round(balance, 11) AS balance, round(net, 11) AS net,
        round(change, 11) AS change, round(change - net, 11) AS implied_return
    FROM (SELECT *, balance - lag(balance) OVER (ORDER BY year) AS change FROM (
        SELECT year, sum(balance) AS balance, max(dt) AS dt FROM (
            SELECT *, row_number() OVER (PARTITION BY year, fund, type) AS rn FROM CLOSING JOIN CR USING (fund))
        WHERE rn = 1 GROUP BY year)
        LEFT JOIN (SELECT year, sum(inflow - outflow) / 1e9 AS net FROM D JOIN CR USING (fund) GROUP BY year)
        USING (year))
    WHERE change IS NOT NULL""",
)
oracle(
    "returns_repeated_classes",
    "D CR RATE",
    """SELECT fund, year, round(ret, 6) AS ret, type, round(benchmark, 6) AS benchmark FROM (
        SELECT fund, year, (last(quota ORDER BY dt, seq) / first(quota ORDER BY dt, seq) - 1) * 100 AS ret
        FROM D GROUP BY fund, year)
    JOIN (SELECT *, row_number() OVER (PARTITION BY fund, type) AS rn FROM CR) USING (fund)
    LEFT JOIN RATE USING (year) WHERE rn = 1""",
)
oracle(
    "study_fixed_income",
    "SD C SX",
    """SELECT CAST(date_trunc('quarter', dt) AS DATE) AS quarter, CASE type WHEN 'AUTOMOBILE' THEN 'Renda Fixa Simples'
        WHEN 'BUILDING' THEN 'Renda Fixa Indexados' ELSE 'Outros' END AS type,
        round(CASE WHEN count(inflow) = count(*) THEN sum(inflow * weight) END / 1e9, 11) AS inflow,
        round(-sum(outflow * weight) / 1e9, 11) AS outflow,
        round(CASE WHEN count(inflow) = count(*) THEN sum(inflow * weight) / 1e9 - sum(outflow * weight) / 1e9 END, 11)
            AS net
    FROM SD JOIN C USING (fund) JOIN SX USING (fund) WHERE category = 'AMERICA' GROUP BY 1, 2""",
)
oracle(
    "study_multimarket",
    "SD C SX RATE",
    """, Y AS (SELECT fund, year, (last(quota ORDER BY dt, seq) / first(quota ORDER BY dt, seq) - 1) * 100 AS ret
        FROM SD GROUP BY fund, year),
    R AS (SELECT fund, Y.year, ret, CASE type WHEN 'AUTOMOBILE' THEN 'Multimercados Livre' ELSE 'Multimercados Macro' END
        AS type, benchmark, type IN ('AUTOMOBILE', 'BUILDING') AS wanted FROM Y JOIN C USING (fund) JOIN SX USING (fund)
        LEFT JOIN RATE ON RATE.year + 20 = Y.year WHERE category = 'ASIA'),
    OUTS AS (SELECT DISTINCT fund FROM R WHERE ret > 200 OR ret < -200)
    SELECT type, year, round(benchmark, 6) AS benchmark,
        CAST(dense_rank() OVER (ORDER BY year) AS INTEGER) AS position, count(x) AS n,
        round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median,
        round(quantile_cont(x, 0.75), 6) AS q3
    FROM (SELECT *, CASE WHEN fund NOT IN (SELECT fund FROM OUTS) THEN ret END AS x FROM R WHERE wanted)
    GROUP BY type, year, benchmark""",
)
oracle(
    "study_equity",
    "SD C SX",
    f"""SELECT {QUARTER_LABEL} AS quarter, CASE type WHEN 'AUTOMOBILE' THEN 'Ações Dividendos'
        WHEN 'BUILDING' THEN 'Ações Livre' ELSE type END AS type, round(sum(balance * weight) / 1e9, 11) AS custody
    FROM SD JOIN C USING (fund) JOIN SX USING (fund) WHERE category = 'EUROPE' GROUP BY 1, 2""",
)
oracle(
    "study_multimarket_flows",
    "SD C",
    """, K AS (SELECT fund FROM C WHERE category = 'ASIA' AND structure = 'Classe'),
    Z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fund, year ORDER BY dt DESC, seq DESC) AS rn FROM SD)
        WHERE rn = 1)
    SELECT CAST(year AS VARCHAR) AS year, dt, round(balance, 11) AS balance, round(net, 11) AS net,
        round(change, 11) AS change, round(change - net, 11) AS implied_return
    FROM (SELECT *, balance - lag(balance) OVER (ORDER BY year) AS change FROM (
        SELECT year, sum(balance) / 1e9 AS balance, max(dt) AS dt FROM Z JOIN K USING (fund) GROUP BY year)
        LEFT JOIN (SELECT year, coalesce(sum(inflow - outflow), 0) / 1e9 AS net FROM SD JOIN K USING (fund) GROUP BY year)
        USING (year))
    WHERE change IS NOT NULL""",
)
# All other reports of a study as (report, key, item, value)


def _long(report: str, keys: list[str], items: dict[str, str], source: str, digits: int = 11, by: str = "") -> str:
    """With ``by`` the items are aggregates over the source's groups."""
    if by:
        columns = ", ".join(f'{sql} AS "{item}"' for item, sql in items.items())
        source, items = f"SELECT {by}, {columns} FROM ({source}) GROUP BY {by}", {item: f'"{item}"' for item in items}
    key = "concat_ws('|', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), '-')" for k in keys) + ")"
    numbers = ", ".join(f"{{'item': '{item}', 'value': CAST({sql} AS DOUBLE)}}" for item, sql in items.items())
    return f"""SELECT report, key, number.item AS item, round(number.value, {digits}) + 0.0 AS value FROM (
        SELECT '{report}' AS report, {key} AS key, unnest([{numbers}]) AS number FROM ({source}))"""


def _kind(first: str, second: str, rest: str = "type") -> str:
    return f"CASE type WHEN 'AUTOMOBILE' THEN '{first}' WHEN 'BUILDING' THEN '{second}' ELSE {rest} END"


def _same(*columns: str) -> dict[str, str]:
    return {c: c for c in columns}


def _profile_reports(region: str, category: str, kind: str) -> list[str]:
    """Of the funds that report; the latest snapshot by date and then by all other columns in the order of their names."""
    funds = f"(SELECT fund FROM SD JOIN C USING (fund) WHERE category = '{region}')"
    yes = "CASE {0} WHEN 'S' THEN 'Sim' WHEN 'N' THEN 'Não' ELSE {0} END AS {0}"
    fees = ("entry_fee", "perf_fee", "exit_fee")
    counted = f"""SELECT *, n * 100.0 / sum(n) OVER () AS share FROM (
        SELECT '{category}' AS category, {kind} AS type, count(*) AS n FROM C WHERE fund IN {funds} GROUP BY 2)"""
    latest = ", ".join(f"{c} DESC NULLS LAST" for c in ("dt", "entry_fee", "exit_fee", "feeder", "mirror", "perf_fee", "policy", "seq"))
    return [
        _long(
            "type_share", ["category", "type"], _same("n", "share", "share_cum"),
            f"SELECT *, sum(share) OVER (ORDER BY n DESC, type ROWS UNBOUNDED PRECEDING) AS share_cum FROM ({counted})", 6,
        ),
        _long("investor_profile", ["investor", "feature"], _same("n"),
              f"SELECT investor, feature, count(*) AS n FROM C WHERE fund IN {funds} GROUP BY ALL"),
        _long(
            "latest_structure", ["policy", "mirror", "feeder"], _same("n"),
            f"""SELECT policy, CASE WHEN mirror = 'S' THEN 'Sim' ELSE 'Não' END AS mirror,
                CASE WHEN feeder = 'N' THEN 'Não' ELSE 'Sim' END AS feeder, count(*) AS n
            FROM (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY {latest}) AS rn FROM XG WHERE fund IN {funds})
            WHERE rn = 1 GROUP BY ALL""",
        ),
        _long(
            "fee_matrix", ["policy", *fees], _same("n"),
            f"""SELECT policy, {", ".join(yes.format(f) for f in fees)}, n FROM (
                SELECT policy, {", ".join(fees)}, count(*) AS n FROM (
                    SELECT DISTINCT dt, fund, policy, {", ".join(fees)} FROM XG WHERE fund IN {funds}) GROUP BY ALL)""",
        ),
    ]


def _quarterly_reports(region: str, kind: str, label: str, lumped: str | None = None) -> dict[str, str]:
    """Every snapshot with a policy repeats the days of its fund.  A gap leaves the whole quarter out, or in flows by type only itself."""
    rows = f"(SELECT *, {lumped or kind} AS kind FROM SD JOIN C USING (fund) JOIN SX USING (fund) WHERE category = '{region}')"
    inflow, outflow = "sum(inflow * weight) / 1e9", "sum(outflow * weight) / 1e9"
    strict = f"""SELECT {QUARTER_START} AS quarter, CASE WHEN count(inflow) = count(*) THEN {inflow} END AS inflow,
        -{outflow} AS outflow, CASE WHEN count(inflow) = count(*) THEN {inflow} - {outflow} END AS net FROM {rows} GROUP BY 1"""
    running = "OVER (ORDER BY quarter ROWS UNBOUNDED PRECEDING)"
    return {
        "quarterly_flow": _long(
            "quarterly_flow", ["quarter"], _same("inflow", "outflow", "net", "net_cum"),
            f"SELECT *, CASE WHEN count(net) {running} = count(*) {running} THEN sum(net) {running} END AS net_cum FROM ({strict})",
        ),
        "flow_by_type": _long(
            "flow_by_type", ["quarter", "kind"], _same("inflow", "outflow") | {"net": "inflow + outflow"},
            f"SELECT {label} AS quarter, kind, {inflow} AS inflow, -{outflow} AS outflow FROM {rows} GROUP BY ALL",
        ),
        "custody_by_type": _long(
            "custody_by_type", ["quarter", "kind"], _same("custody"),
            f"SELECT {label} AS quarter, kind, sum(balance * weight) / 1e9 AS custody FROM {rows} GROUP BY ALL",
        ),
    }


def _study_reports(name: str, roles: str, parts: list[str]) -> None:
    oracle(name, roles, "\nUNION ALL\n".join(parts))


_KIND = _kind("Renda Fixa Simples", "Renda Fixa Indexados")
_BY_QUARTER = _quarterly_reports("AMERICA", _KIND, QUARTER_START, _kind("Renda Fixa Simples", "Renda Fixa Indexados", "'Outros'"))
_study_reports(
    "study_fixed_income_reports", "SD C SX XG",
    [*_profile_reports("AMERICA", "Renda Fixa", _KIND), _BY_QUARTER["quarterly_flow"], _BY_QUARTER["custody_by_type"]],
)
_KIND = _kind("Multimercados Livre", "Multimercados Macro")
_BY_QUARTER = _quarterly_reports("ASIA", _KIND, QUARTER_LABEL)
_study_reports("study_multimarket_reports", "SD C SX XG", [*_profile_reports("ASIA", "Multimercados", _KIND), *_BY_QUARTER.values()])
_KIND = _kind("Ações Dividendos", "Ações Livre")
_BY_QUARTER = _quarterly_reports("EUROPE", _KIND, QUARTER_LABEL)
_study_reports(
    "study_equity_reports", "SD C SX XG I",
    [
        *_profile_reports("EUROPE", "Ações", _KIND), _BY_QUARTER["quarterly_flow"], _BY_QUARTER["flow_by_type"],
        _long(
            "return_quartiles_1", ["type", "year"], _same("benchmark", "position", "n", "q1", "median", "q3"),
            f"""WITH Y AS (SELECT fund, year, (last(quota ORDER BY dt, seq) / first(quota ORDER BY dt, seq) - 1) * 100 AS ret
                FROM SD WHERE year BETWEEN 2010 AND 2024 GROUP BY fund, year),
            B AS (SELECT year(dt) + 20 AS year, (last(close ORDER BY dt) / first(close ORDER BY dt) - 1) * 100 AS benchmark
                FROM I WHERE dt <> DATE '1992-01-02' GROUP BY 1),
            R AS (SELECT fund, Y.year, ret, {_KIND} AS type, benchmark, type IN ('AUTOMOBILE', 'BUILDING') AS wanted
                FROM Y JOIN C USING (fund) JOIN SX USING (fund) LEFT JOIN B ON B.year = Y.year WHERE category = 'EUROPE')
            SELECT type, year, benchmark, dense_rank() OVER (ORDER BY year) AS position, count(x) AS n, quantile_cont(x, 0.25) AS q1,
                quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
            FROM (SELECT *, CASE WHEN fund NOT IN (SELECT fund FROM R WHERE ret > 500 OR ret < -500) THEN ret END AS x FROM R WHERE wanted)
            GROUP BY type, year, benchmark""", 6,
        ),
    ],
)
_OPEN = ["Multimercados Investimento no Exterior", "Multimercados Livre", "Multimercados Macro", "Outros"]
_FLOW_YEARS = range(2015, 2026)
_OPEN_ROWS = f"""(SELECT SD.*, {_kind("Multimercados Livre", "Multimercados Macro")} AS kind,
    {_kind("Multimercados Livre", "Multimercados Macro", "'Outros'")} AS lumped, CAST(date_trunc('month', dt) AS DATE) AS month
    FROM SD JOIN C USING (fund) WHERE category = 'ASIA' AND structure = 'Classe' AND year BETWEEN 2015 AND 2025)"""
_NET = "coalesce(sum(inflow - outflow), 0) / 1e9"
_MONTH_TYPES = f"(SELECT month, lumped, {_NET} AS net FROM {_OPEN_ROWS} GROUP BY ALL)"
_MONTHS = f"""SELECT month, coalesce(sum(inflow), 0) / 1e9 AS inflow, -coalesce(sum(outflow), 0) / 1e9 AS outflow,
    coalesce(sum(inflow), 0) / 1e9 - coalesce(sum(outflow), 0) / 1e9 AS net FROM {_OPEN_ROWS} GROUP BY month"""
_study_reports(
    "study_multimarket_flows_reports", "SD C",
    [
        _long("type_year_counts", ["kind"], {str(y): f"count(DISTINCT fund) FILTER (WHERE year = {y})" for y in _FLOW_YEARS},
              f"SELECT * FROM {_OPEN_ROWS}", by="kind"),
        _long("annual_net_by_type", ["year"], {k: f"coalesce(sum(net) FILTER (WHERE lumped = '{k}'), 0)" for k in _OPEN} | {"total": "sum(net)"},
              f"SELECT year(month) AS year, lumped, net FROM {_MONTH_TYPES}", by="year"),
        _long("annual_net_by_year", ["lumped"], {str(y): f"coalesce(sum(net) FILTER (WHERE year(month) = {y}), 0)" for y in _FLOW_YEARS} | {"total": "sum(net)"},
              f"SELECT * FROM {_MONTH_TYPES}", by="lumped"),
        _long("monthly_flow", ["month"], _same("inflow", "outflow", "net"), _MONTHS),
        _long("rolling_flow", ["month", "lumped"], _same("net", "net_rolling"),
              f"""SELECT *, sum(net) OVER w AS net_rolling FROM {_MONTH_TYPES}
              WINDOW w AS (PARTITION BY lumped ORDER BY month ROWS 11 PRECEDING) QUALIFY count(*) OVER w = 12"""),
        _long("cumulative_flow", ["month"], _same("inflow", "outflow", "net", "net_cum"),
              f"SELECT *, sum(net) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS net_cum FROM ({_MONTHS})"),
        _long("cumulative_flow_by_type", ["month", "lumped"], _same("net", "net_cum"),
              f"SELECT *, sum(net) OVER (PARTITION BY lumped ORDER BY month ROWS UNBOUNDED PRECEDING) AS net_cum FROM {_MONTH_TYPES}"),
        _long("year_end_balance", ["year", "dt"], {k: f"coalesce(sum(balance) FILTER (WHERE lumped = '{k}'), 0)" for k in _OPEN} | {"total": "sum(balance)"},
              f"""SELECT year, lumped, sum(balance) / 1e9 AS balance, max(dt) AS dt FROM (
                  SELECT *, row_number() OVER (PARTITION BY fund, year ORDER BY dt DESC, seq DESC) AS rn FROM {_OPEN_ROWS})
              WHERE rn = 1 GROUP BY year, lumped""", by="year, dt"),
    ],
)
oracle("annual_return", "RY", "SELECT fund, year, round(ret, 6) AS ret FROM RY")
oracle(
    "annual_return_missing",
    "DLG",
    """SELECT fund, year,
        round((last(quota ORDER BY dt, k1, k2) / first(quota ORDER BY dt, k1, k2) - 1) * 100, 6) AS ret
    FROM DLG GROUP BY fund, year""",
)
oracle(
    "annual_return_nonnull",
    "DLG",
    """SELECT fund, year, round(ret, 6) AS ret FROM (
        SELECT fund, year, (arg_max(quota, ROW(dt, k1, k2)) / arg_min(quota, ROW(dt, k1, k2)) - 1) * 100 AS ret
        FROM DLG GROUP BY fund, year) WHERE isfinite(ret) AND ret > -100 AND ret < 300""",
)
oracle("rate_compound", "RATE", "SELECT year, round(benchmark, 6) AS benchmark FROM RATE")
oracle(
    "rate_compound_skipping",
    "M",
    """SELECT CAST(year(dt) AS INTEGER) AS year,
        round((product(1 + CASE WHEN month(dt) <> 5 THEN rate_pct END / 100) - 1) * 100, 6) AS skipping,
        round(CASE WHEN count(*) FILTER (WHERE month(dt) = 5) = 0 THEN (product(1 + rate_pct / 100) - 1) * 100 END, 6)
            AS strict FROM M GROUP BY 1""",
)
oracle(
    "rate_running",
    "M",
    """SELECT dt, round((product(1 + rate_pct / 100) OVER (PARTITION BY year(dt) ORDER BY dt
        ROWS UNBOUNDED PRECEDING) - 1) * 100, 6) AS running FROM M""",
)
oracle("index_annual_return", "INDEXED", "SELECT year, round(benchmark, 6) AS benchmark FROM INDEXED")
oracle(
    "return_vs_benchmark",
    "RT",
    "SELECT fund, year, round(ret, 6) AS ret, type, round(benchmark, 6) AS benchmark FROM RT",
)
oracle(
    "return_vs_index",
    "RY CL INDEXED",
    """SELECT fund, year, round(ret, 6) AS ret, type, round(benchmark, 6) AS benchmark
    FROM RY LEFT JOIN CL USING (fund) LEFT JOIN INDEXED USING (year)""",
)
oracle("outlier_funds", "RY", "SELECT DISTINCT fund FROM RY WHERE ret > 500 OR ret < -500")
oracle(
    "return_outlier_excluded",
    "KEPT",
    "SELECT fund, year, round(ret, 6) AS ret, type, round(benchmark, 6) AS benchmark FROM KEPT",
)
oracle(
    "return_outlier_excluded_200",
    "RY",
    """SELECT fund, year, round(ret, 6) AS ret FROM RY
    WHERE NOT EXISTS (SELECT 1 FROM RY B WHERE B.fund = RY.fund AND (B.ret > 200 OR B.ret < -200))""",
)
for _name, _wanted in (
    ("return_quartiles", "type IN ('AFRICA', 'ASIA', 'EUROPE')"),
    ("return_quartiles_others", "(type IS NULL OR type NOT IN ('AFRICA', 'ASIA', 'EUROPE'))"),
):
    oracle(
        _name,
        "KEPT",
        f"""SELECT type, year, round(benchmark, 6) AS benchmark, position, coalesce(n, 0) AS n, round(q1, 6) AS q1,
            round(median, 6) AS median, round(q3, 6) AS q3
        FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY year) AS INTEGER) AS position
            FROM (SELECT DISTINCT type, year, benchmark FROM RT WHERE {_wanted}))
        LEFT JOIN (SELECT type, year, count(ret) AS n, quantile_cont(ret, 0.25) AS q1,
            quantile_cont(ret, 0.5) AS median, quantile_cont(ret, 0.75) AS q3
            FROM KEPT WHERE {_wanted} GROUP BY type, year) USING (type, year)""",
    )
oracle(
    "quartiles_by_selection",
    "DL",
    """SELECT flag, count(*) AS n, round(min(quota), 6) AS low, round(quantile_cont(quota, 0.25), 6) AS q1,
        round(quantile_cont(quota, 0.5), 6) AS median, round(quantile_cont(quota, 0.75), 6) AS q3,
        round(max(quota), 6) AS high FROM DL GROUP BY flag""",
)
oracle(
    "return_boxplot",
    "TRIMMED RATE",
    """SELECT type_short, type, year, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
        round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high, round(benchmark, 6) AS benchmark,
        CAST(dense_rank() OVER (ORDER BY year) AS INTEGER) AS position
    FROM (SELECT type_short, type, year, b1 AS q1, b2 AS median, b3 AS q3, count(*) AS n,
            min(ret) FILTER (WHERE ret >= b1 - 1.5 * (b3 - b1)) AS whisker_low,
            max(ret) FILTER (WHERE ret <= b3 + 1.5 * (b3 - b1)) AS whisker_high
        FROM (SELECT type_short, type, year, ret, quantile_cont(ret, 0.25) OVER w AS b1,
                quantile_cont(ret, 0.5) OVER w AS b2, quantile_cont(ret, 0.75) OVER w AS b3
            FROM TRIMMED WINDOW w AS (PARTITION BY type, year)) GROUP BY ALL)
    LEFT JOIN RATE USING (year)""",
)
oracle(
    "return_density",
    "KEPT",
    """SELECT type, year, CAST(point AS INTEGER) AS point, round(x, 6) AS at, round(h, 6) AS bandwidth,
        round(sum(exp(-0.5 * pow((x - ret) / h, 2))) / (n * h * sqrt(2 * pi())), 10) AS density
    FROM (SELECT type, year, ret, n, h, point, low + point * (high - low) / 511 AS x
        FROM KEPT JOIN (SELECT type, year, count(*) AS n, min(ret) AS low, max(ret) AS high,
            0.9 * coalesce(
                nullif(least(stddev_samp(ret), (quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25)) / 1.34), 0),
                nullif(stddev_samp(ret), 0), nullif(abs(min(ret)), 0), 1) * pow(count(*), -0.2) AS h
            FROM KEPT GROUP BY type, year HAVING count(*) >= 2) USING (type, year), range(512) AS g(point))
    GROUP BY type, year, point, x, h, n""",
)
oracle(
    "iqr_trimmed_returns",
    "TRIMMED",
    """SELECT fund, year, round(ret, 6) AS ret, type, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
        round(lower, 6) AS lower, round(upper, 6) AS upper, type_short FROM TRIMMED""",
)
oracle(
    "top5_types",
    "RY CL",
    """SELECT nation AS type, count(DISTINCT fund) AS n FROM RY JOIN CL USING (fund) GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 5""",
)
oracle(
    "funds_by_type",
    "RY CL",
    "SELECT nation AS type, count(DISTINCT fund) AS n FROM RY JOIN CL USING (fund) GROUP BY 1",
)

ORACLES["month_spine"] = """SELECT CAST(m AS DATE) AS month, strftime(m, '%Y%m') AS yyyymm FROM (
    SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
        INTERVAL 1 MONTH)) AS m FROM orders)"""
ORACLES["year_spine"] = """SELECT CAST(y AS INTEGER) AS year FROM (
    SELECT unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)))) AS y FROM orders)"""
MARKED = """substr(id, 1, 2) || '.' || substr(id, 3, 3) || '.' || substr(id, 6, 3) || '/' || substr(id, 9, 4) || '-' ||
    substr(id, 13, 2)"""
oracle(
    "union_by_name",
    "D",
    f"""SELECT {MARKED} AS CNPJ_FUNDO, dt AS DT_COMPTC, quota AS VL_QUOTA, balance AS VL_PATRIM_LIQ,
        inflow AS CAPTC_DIA, outflow AS RESG_DIA
    FROM (SELECT *, lpad(CAST(fund AS VARCHAR), 14, '0') AS id FROM D) WHERE dt < DATE '1998-01-01'
    UNION ALL BY NAME
    SELECT 'CLASSES - FIF' AS TP_FUNDO_CLASSE, {MARKED} AS CNPJ_FUNDO_CLASSE, dt AS DT_COMPTC, quota AS VL_QUOTA,
        balance AS VL_PATRIM_LIQ, inflow AS CAPTC_DIA, outflow AS RESG_DIA
    FROM (SELECT *, lpad(CAST(fund AS VARCHAR), 14, '0') AS id FROM D) WHERE dt >= DATE '1998-01-01'""",
)
for _name in ("csv_two_vintages", "zip_ingest", "ingest_consolidated"):
    oracle(
        _name,
        "D",
        """SELECT year, CASE WHEN dt >= DATE '1998-01-01' THEN 'CLASSES - FIF' END AS fund_kind, count(*) AS n,
            count(DISTINCT fund) AS funds, round(sum(quota), 2) AS quota, round(sum(inflow), 2) AS inflow,
            round(sum(outflow), 2) AS outflow FROM D GROUP BY 1, 2""",
    )
ORACLES["csv_codepage_roundtrip"] = """SELECT doc_id, lang, length(x) AS length, md5(x) AS digest FROM (
    SELECT doc_id, lang, trim(trim(regexp_replace(text,
        '[^ -:<-~\\x{A0}-\\x{FF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', ' ', 'g')) || ' €–”') AS x FROM documents)"""
oracle(
    "table_write_modes",
    "D",
    """SELECT year, count(*) AS n, round(sum(CASE WHEN year = 2001 THEN inflow * 2 ELSE inflow END), 2) AS inflow,
        TRUE AS refused FROM D GROUP BY year""",
)

oracle(
    "table_overwrite",
    "D",
    "SELECT year, count(*) AS n, round(sum(outflow), 2) AS outflow FROM D WHERE status = 'F' GROUP BY year",
)
oracle(
    "restate_month",
    "D",
    """SELECT CAST(date_trunc('month', dt) AS DATE) AS month, count(*) AS n,
        round(sum(CASE WHEN year = 1997 AND month(dt) = 3 THEN inflow * 2 ELSE inflow END), 2) AS inflow,
        round(sum(outflow), 2) AS outflow, TRUE AS refused FROM D GROUP BY 1""",
)
oracle(
    "merge_published_again",
    "D",
    """, E AS (SELECT * REPLACE (CASE WHEN seq % 97 <> 0 THEN dt END AS dt) FROM D),
    M AS (SELECT *, year(dt) = 1997 AND month(dt) = 3 AS here FROM E),
    A AS (SELECT * FROM M WHERE here AND fund % 3 <> 0),
    R AS (SELECT rule, dt, fund, CASE WHEN rule <> 'refused' AND here AND fund % 3 <> 0 THEN inflow * 2 ELSE inflow END AS inflow, outflow
        FROM M, (VALUES ('kept'), ('ended'), ('undated'), ('refused')) AS x(rule)
        WHERE rule <> 'ended' OR here IS NOT TRUE OR fund % 3 <> 0
        UNION ALL SELECT 'undated', dt, fund, 1.0, outflow FROM M u WHERE dt IS NULL AND fund % 4 = 0 AND inflow <> 1.0)
    SELECT rule, CAST(date_trunc('month', dt) AS DATE) AS month, rule = 'refused' AS refused, count(*) AS n, count(DISTINCT fund) AS funds,
        round(sum(inflow), 2) AS inflow, round(sum(outflow), 2) AS outflow FROM R GROUP BY ALL""",
)
oracle(
    "upkeep_of_partials",
    "D",
    """, E AS (SELECT fund, dt, seq, balance, outflow,
        CASE WHEN year(dt) = 1997 AND month(dt) = 3 AND fund % 3 <> 0 THEN 2 ELSE 1 END AS twice, quota * twice AS quota, inflow * twice AS inflow
        FROM D WHERE NOT (year(dt) = 1999 AND month(dt) = 5)),
    Y AS (SELECT fund, year(dt) AS y, arg_min(quota, (dt, seq)) AS first, arg_max(quota, (dt, seq)) AS last, arg_max(balance, (dt, seq)) AS balance,
        sum(inflow - outflow) AS net FROM E GROUP BY ALL)
    SELECT 'months' AS "table", CAST(date_trunc('month', dt) AS DATE) AS dt, CAST(count(*) AS BIGINT) AS n, round(sum(inflow), 2) AS inflow,
        round(sum(inflow - outflow), 2) AS net, CAST(NULL AS DOUBLE) AS ret, '1997-3,1999-5' AS changed FROM E GROUP BY 2
    UNION ALL SELECT 'years', make_date(y, 1, 1), count(*), round(sum(balance), 2), round(sum(net), 2), round(sum(last - first), 2), '1997-3,1999-5'
    FROM Y GROUP BY y""",
)
oracle(
    "price_density_binned",
    "DL",
    """, S AS (SELECT flag, count(*) AS n, min(quota) AS low, max(quota) AS high, (high - low) / 511 AS step,
        0.9 * least(stddev_samp(quota), (quantile_cont(quota, 0.75) - quantile_cont(quota, 0.25)) / 1.34) * pow(count(*), -0.2) AS h
        FROM DL GROUP BY flag),
    P AS (SELECT flag, least((quota - low) / step, 511.0) AS place FROM DL JOIN S USING (flag)),
    B AS (SELECT flag, bin, sum(weight) AS weight FROM (
        SELECT flag, floor(place) AS bin, 1 - (place - floor(place)) AS weight FROM P
        UNION ALL SELECT flag, floor(place) + 1, place - floor(place) FROM P) WHERE weight > 0 GROUP BY ALL)
    SELECT flag, CAST(point AS INTEGER) AS point, round(low + point * step, 6) AS at, round(h, 6) AS bandwidth,
        round(sum(weight * exp(-0.5 * pow((bin - point) * step / h, 2))) / (n * h * sqrt(2 * pi())), 10) AS density
    FROM B JOIN S USING (flag), range(512) AS g(point) GROUP BY flag, point, low, step, h, n""",
)
oracle(
    "active_funds_any_period",
    "D C",
    """, P(period, first, last) AS (VALUES ('1996-11..1997-02', DATE '1996-11-01', DATE '1997-02-28'),
        ('1995-01..2001-12', DATE '1995-01-01', DATE '2001-12-31'), ('1998-03..1998-03', DATE '1998-03-01', DATE '1998-03-31')),
    F AS (SELECT DISTINCT fund, dt, type FROM D LEFT JOIN C USING (fund))
    SELECT CAST(year(dt) AS VARCHAR) AS period, type, count(DISTINCT fund) AS n FROM F GROUP BY ALL
    UNION ALL SELECT period, type, count(DISTINCT fund) FROM F JOIN P ON dt BETWEEN first AND last GROUP BY ALL
    UNION ALL SELECT period, 'all', count(DISTINCT fund) FROM F JOIN P ON dt BETWEEN first AND last GROUP BY ALL""",
)
oracle(
    "running_total_by_ranges",
    "D",
    """SELECT fund, dt, seq, round(inflow, 2) AS inflow, round(sum(inflow) OVER (ORDER BY dt, seq ROWS UNBOUNDED PRECEDING), 2) AS total,
        dense_rank() OVER (ORDER BY fund) AS fund_number FROM D""",
)
ORACLES["csv_quoted_breaks"] = r"""WITH T AS (SELECT doc_id, lang, regexp_replace(text, '[\r\t"]', ' ', 'g') AS text FROM documents)
SELECT mode, doc_id, lang, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n, md5(text) AS digest
FROM T, (VALUES ('files'), ('archives')) AS m(mode)
UNION ALL SELECT 'unquoted', NULL, NULL,
    CAST(sum(len(list_filter(string_split(doc_id || ';"' || text || '";' || lang, chr(10)), lambda x: trim(x) <> ''))) AS BIGINT), NULL FROM T"""
ORACLES["ingest_problems"] = (
    "WITH D AS ("
    + ROLES["D"]
    + """), P AS (SELECT *, dt < DATE '1998-01-01' AS archived, lpad(CAST(fund AS VARCHAR), 14, '0') AS id,
        CAST(CAST(floor(quota) AS BIGINT) AS VARCHAR) || CASE WHEN day(dt) = 3 THEN ',5' ELSE '' END AS q,
        CAST(CAST(floor(outflow) AS BIGINT) AS VARCHAR) || CASE WHEN day(dt) = 4 THEN ';1;2' ELSE '' END AS o
        FROM D), L AS (SELECT *, CASE WHEN archived THEN '' ELSE 'CLASSES - FIF;' END || """
    + "substr(id, 1, 2) || '.' || substr(id, 3, 3) || '.' || substr(id, 6, 3) || '/' || substr(id, 9, 4) || '-' || substr(id, 13, 2)"
    + """ || ';' || dt || ';' || q || ';' || CAST(CAST(floor(balance) AS BIGINT) AS VARCHAR) || ';' || CAST(CAST(floor(inflow) AS BIGINT) AS VARCHAR) || ';' || o AS line FROM P)
SELECT line, archived, count(*) AS n, 0 AS quotas FROM L WHERE day(dt) IN (3, 4) GROUP BY 1, 2
UNION ALL SELECT 'rows kept', FALSE, count(*), count(*) FILTER (WHERE day(dt) <> 3) FROM L WHERE NOT archived"""
)

PUBLISHED_CLASSES = """SELECT lpad(CAST(fund AS VARCHAR), 14, '0') AS fund, category, type, investor, feature, structure,
    CAST(fund * 100 AS VARCHAR) AS minimum_deposit, CAST(NULL AS VARCHAR) AS name FROM C"""
oracle("classes_published", "C", PUBLISHED_CLASSES)
oracle(
    "snapshots_published",
    "X",
    """SELECT dt, lpad(CAST(fund AS VARCHAR), 14, '0') AS fund, policy, mirror, feeder, entry_fee, perf_fee, exit_fee,
        CAST(NULL AS VARCHAR) AS audience, count(*) AS n FROM X GROUP BY ALL""",
)
oracle("rates_published", "RATE", "SELECT year, round(benchmark, 6) AS benchmark FROM RATE")
oracle("closes_published", "INDEXED", "SELECT year, round(benchmark, 6) AS benchmark FROM INDEXED")

ORACLES["job_table"] = """SELECT o_orderpriority AS institution, o_orderkey AS entry,
    CASE WHEN o_orderstatus = 'O' THEN 'Atual' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS "end"
FROM orders WHERE o_totalprice > 200000 AND o_orderpriority <> '4-NOT SPECIFIED'"""
oracle("catalog_page", "T", "SELECT doc_id, dt FROM T ORDER BY dt DESC, doc_id LIMIT 36 OFFSET 72")
oracle("catalog_first_page", "T", "SELECT doc_id, dt FROM T ORDER BY dt DESC, doc_id LIMIT 3")
ORACLES["category_counts"] = """SELECT 'Tudo' AS category, count(*) AS n FROM documents
UNION ALL SELECT lang, count(*) FROM documents GROUP BY lang
UNION ALL SELECT source, count(*) FROM documents GROUP BY source"""
oracle("category_filter", "T", "SELECT doc_id, dt FROM T WHERE list_contains(categories, 'fr')")
ORACLES["reading_time"] = r"""SELECT doc_id, words, CAST(ceil(words / 200) AS BIGINT) AS minutes FROM (
    SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS words
    FROM documents)"""
