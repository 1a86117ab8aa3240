"""The test tables in the roles the library expects.

Orders play the daily reports of customers, lines the denser daily reports of suppliers, and the
customers' market segments and regions the classification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


FIRST, LAST = 1995, 2001
QUARTERS = (FIRST, 1), (LAST, 4)
TYPES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
OPEN_TYPES = ["BUILDING", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NEW_IDS_FROM = "1998-01-01"


# Columns in use.  Naming them saves the job that looks them up in the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = F.col("o_orderstatus") == "F"
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("fund"),
        F.col("o_orderdate").cast("date").alias("dt"),
        F.col("o_orderkey").alias("seq"),
        price.alias("quota"),
        price.alias("balance"),
        F.when(~finished, price).otherwise(F.lit(0.0)).alias("inflow"),
        F.when(finished, price).otherwise(F.lit(0.0)).alias("outflow"),
        F.col("o_orderstatus").alias("status"),
    )


DENSE_ORDER = ["dt", "k1", "k2"]


def dense_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("fund"),
        F.col("l_shipdate").cast("date").alias("dt"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("k1"),
        F.col("l_partkey").alias("k2"),
        F.col("l_extendedprice").alias("quota"),
        F.col("l_returnflag").alias("flag"),
    )


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return nation.join(table(spark, sf_dir, "region"), "r_regionkey")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    balance = F.col("c_acctbal")
    turn = F.col("c_custkey") % 3
    return customer.join(_regions(spark, sf_dir), "n_nationkey").select(
        F.col("c_custkey").alias("fund"),
        F.col("r_name").alias("category"),
        F.col("c_mktsegment").alias("type"),
        F.when(balance < 2500, "Geral").when(balance < 6000, "Qualificado").otherwise("Profissional").alias("investor"),
        F.when(turn == 0, "Exclusivo").when(turn == 1, "Reservado").otherwise("Sem restricao").alias("feature"),
        F.when(balance < 0, "Subclasse").otherwise("Classe").alias("structure"),
    )


def dense_classes(spark: SparkSession, sf_dir: str, by_nation: bool = False) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return supplier.join(_regions(spark, sf_dir), "n_nationkey").select(
        F.col("s_suppkey").alias("fund"), F.col("n_name" if by_nation else "r_name").alias("type")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")

    def flag(condition: Column) -> Column:
        return F.when(condition, "S").otherwise("N")

    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("fund"),
        F.col("o_orderdate").cast("date").alias("dt"),
        key.alias("seq"),
        F.col("o_orderpriority").alias("policy"),
        F.when(status == "P", None).when(status == "O", "N").otherwise("S").alias("mirror"),
        F.when(key % 5 == 0, None).when(key % 2 == 0, "N").otherwise("S").alias("feeder"),
        flag(key % 11 == 0).alias("entry_fee"),
        flag(F.col("o_totalprice") > 200000).alias("perf_fee"),
        flag(key % 7 == 0).alias("exit_fee"),
    )


def snapshots_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots some of which state no policy."""
    return snapshots(spark, sf_dir).withColumn("policy", F.nullif(F.col("policy"), F.lit("5-LOW")))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc(F.col("l_shipdate").cast("date"), "MM").cast("date")
    return (
        table(spark, sf_dir, "lineitem").groupBy(month.alias("dt")).agg((F.avg("l_discount") * 10).alias("rate_pct"))
    )


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date").alias("dt")
    return table(spark, sf_dir, "lineitem").groupBy(day).agg(F.max("l_extendedprice").alias("close"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts; the date follows from the id."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.array("lang", "source").alias("categories"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 730).cast("int")).alias("dt"),
    )


def padded_id(key: Column) -> Column:
    return F.lpad(key.cast("string"), 14, "0")


def punctuated_id(key: Column) -> Column:
    return F.regexp_replace(padded_id(key), "^(..)(...)(...)(....)(..)$", "$1.$2.$3/$4-$5")


def raw_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily reports under the published names, the id column depending on the date."""
    rows = daily(spark, sf_dir)
    old = F.col("dt") < F.lit(NEW_IDS_FROM).cast("date")
    return rows.select(
        F.when(old, punctuated_id(F.col("fund"))).alias("CNPJ_FUNDO"),
        F.when(~old, punctuated_id(F.col("fund"))).alias("CNPJ_FUNDO_CLASSE"),
        F.when(old, "FI").alias("TP_FUNDO"),
        F.when(~old, "CLASSES - FIF").alias("TP_FUNDO_CLASSE"),
        F.col("dt").alias("DT_COMPTC"),
        F.col("quota").alias("VL_QUOTA"),
        F.col("balance").alias("VL_PATRIM_LIQ"),
        F.col("inflow").alias("CAPTC_DIA"),
        F.col("outflow").alias("RESG_DIA"),
    )


def classes_by_text_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, sf_dir).withColumn("fund", padded_id(F.col("fund")))


def vintages(raw: DataFrame) -> list[DataFrame]:
    """Raw daily rows in the two column sets they were published with."""
    values = ["DT_COMPTC", "VL_QUOTA", "VL_PATRIM_LIQ", "CAPTC_DIA", "RESG_DIA"]
    old = raw.where(F.col("CNPJ_FUNDO").isNotNull()).select("CNPJ_FUNDO", *values)
    new = raw.where(F.col("CNPJ_FUNDO").isNull()).select("TP_FUNDO_CLASSE", "CNPJ_FUNDO_CLASSE", *values)
    return [old, new]


# The studies look at years after 2010, and at categories and types by name.
STUDY_YEARS = 20
STUDY_TYPES = {
    "Renda Fixa": ["Renda Fixa Simples", "Renda Fixa Indexados"],
    "Multimercados": ["Multimercados Livre", "Multimercados Macro"],
    "Ações": ["Ações Dividendos", "Ações Livre"],
}


def later(d: Column) -> Column:
    return F.add_months(d, 12 * STUDY_YEARS)


def study_tables(spark: SparkSession, sf_dir: str, region: str, category: str) -> tuple[DataFrame, ...]:
    """Daily rows with gaps, classes, snapshots with gaps and rates as a study of ``category`` expects them."""
    rows = daily(spark, sf_dir).withColumn("inflow", F.when(F.col("status") != "P", F.col("inflow"))).drop("status")
    rows = rows.withColumns({"fund": padded_id(F.col("fund")), "dt": later(F.col("dt"))})
    first, second = STUDY_TYPES[category]
    kind = F.col("type")
    kind = F.when(kind == "AUTOMOBILE", first).when(kind == "BUILDING", second).otherwise(kind)
    known = classes_by_text_id(spark, sf_dir).where(F.col("category") == region)
    known = known.withColumns({"category": F.lit(category), "type": kind})
    seen = snapshots_with_gaps(spark, sf_dir)
    seen = seen.withColumns({"fund": padded_id(F.col("fund")), "dt": later(F.col("dt"))})
    return rows, known, seen, rates(spark, sf_dir).withColumn("dt", later(F.col("dt")))
