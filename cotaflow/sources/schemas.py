"""Column names and types of the published files, and the names the library uses for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.functions.text import digits_only, drop_marks

# Column names of the published files and the type each is read as.
DAILY_TYPES = {
    "TP_FUNDO": "string",
    "TP_FUNDO_CLASSE": "string",
    "CNPJ_FUNDO": "string",
    "CNPJ_FUNDO_CLASSE": "string",
    "DT_COMPTC": "date",
    "VL_TOTAL": "double",
    "VL_QUOTA": "double",
    "VL_PATRIM_LIQ": "double",
    "CAPTC_DIA": "double",
    "RESG_DIA": "double",
    "NR_COTST": "bigint",
}

CLASS_COLUMNS = {
    "Código ANBIMA": "code",
    "Estrutura": "structure",
    "CNPJ do Fundo": "fund",
    "Nome Comercial": "name",
    "Status": "status",
    "Categoria ANBIMA": "category",
    "Tipo ANBIMA": "type",
    "Composição do Fundo": "composition",
    "Aberto Estatutariamente": "open_ended",
    "Tributação Alvo": "taxation",
    "Primeiro Aporte": "first_deposit",
    "Tipo de Investidor": "investor",
    "Característica do Investidor": "feature",
    "Cota de Abertura": "opening_quota",
    "Aplicação Inicial Mínima": "minimum_deposit",
    "Prazo Pagamento Resgate em dias": "redemption_days",
}

SNAPSHOT_COLUMNS = {
    "DT_COMPTC": "dt",
    "CNPJ_FUNDO_CLASSE": "fund",
    "PUBLICO_ALVO": "audience",
    "DISTRIB": "distribution",
    "POLIT_INVEST": "policy",
    "FUNDO_COTAS": "feeder",
    "FUNDO_ESPELHO": "mirror",
    "APLIC_MIN": "minimum_deposit",
    "ATUALIZ_DIARIA_COTA": "daily_quota",
    "TAXA_SAIDA_PAGTO_RESGATE": "exit_charge",
    "TAXA_ADM": "admin_charge",
    "EXISTE_TAXA_PERFM": "perf_fee",
    "TAXA_PERFM": "perf_charge",
    "PARAM_TAXA_PERFM": "perf_reference",
    "CALC_TAXA_PERFM": "perf_method",
    "EXISTE_TAXA_INGRESSO": "entry_fee",
    "EXISTE_TAXA_SAIDA": "exit_fee",
    "INVEST_EXTERIOR": "abroad",
    "ATIVO_CRED_PRIV": "private_credit",
}

RATE_COLUMNS = {"date": "dt", "4391": "rate_pct"}

CLOSE_COLUMNS = {"index": "dt", "BVSP.Close": "close"}

JOB_COLUMNS = {
    "secao": "section",
    "Intituição": "institution",
    "Função": "role",
    "Local": "place",
    "Inicio": "start",
    "Fim": "end",
    "Descrição": "description",
}


def renamed(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The listed columns, and only those, under the names of the library."""
    return raw.select(*[F.col(f"`{name}`").alias(short) for name, short in columns.items()])


def daily_reports(raw: DataFrame) -> DataFrame:
    """Daily reports in library names: one cleaned id whichever of the two id columns a row carries."""
    return raw.select(
        digits_only(F.coalesce("CNPJ_FUNDO", "CNPJ_FUNDO_CLASSE")).alias("fund"),
        F.coalesce("TP_FUNDO", "TP_FUNDO_CLASSE").alias("fund_kind"),
        F.to_date("DT_COMPTC").alias("dt"),
        F.col("VL_QUOTA").alias("quota"),
        F.col("VL_PATRIM_LIQ").alias("balance"),
        F.col("CAPTC_DIA").alias("inflow"),
        F.col("RESG_DIA").alias("outflow"),
    )


def classes(raw: DataFrame) -> DataFrame:
    """Classification table in library names."""
    return renamed(raw, CLASS_COLUMNS)


def snapshots(raw: DataFrame) -> DataFrame:
    """Qualitative snapshots in library names, with the id freed of its punctuation."""
    named = renamed(raw, SNAPSHOT_COLUMNS)
    return named.withColumns({"fund": drop_marks(F.col("fund")), "dt": F.to_date("dt")})


def rates(raw: DataFrame) -> DataFrame:
    """Monthly rate in library names."""
    return renamed(raw, RATE_COLUMNS).withColumn("dt", F.to_date("dt"))


def closes(raw: DataFrame) -> DataFrame:
    """Daily index in library names."""
    return renamed(raw, CLOSE_COLUMNS).withColumn("dt", F.to_date("dt"))


def job_entries(raw: DataFrame) -> DataFrame:
    """Job entries in library names."""
    return renamed(raw, JOB_COLUMNS)
