"""A training-data pipeline over ``documents``: every stage calls one operator of ``cotaflow.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotaflow.llm import bpe, mixing, neardup, substring, toxicity
from cotaflow.llm.queries import tokenizer_path
from cotaflow.sources.scratch import staged

#: SQL has no words for trained scores, signatures or merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go; the lexicon is learned from the labels of those that are there.

    Null and empty texts score as texts without words, so they stay unless such texts are labelled toxic; repeated rows and
    rows without an id are judged one by one, alike where texts are.  Without labels of both kinds nothing goes;
    no rows give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit(docs, labels, "toxic")
    return toxicity.score(docs, lexicon, carry=docs.columns).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest id; of repeated rows, one.

    Null and empty texts have no duplicates but repeated rows.  Rows without an id stay if any of them belongs to no
    group with an id, since nothing else tells them apart.  No rows give no rows.
    """
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    chosen = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id"))).drop("_kept_id")
    return chosen.dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that occur elsewhere are cut out of the texts, and ``n_chars`` follows; no document goes.

    White space around a passage stays; texts without such passages, null ones too, are left as they are.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substring.remove_repeats(docs, carry=["n_chars", *rest], as_written=True)
    new = F.col("n_removed") > 0
    cut = cut.select(
        "doc_id", F.col("kept_text").alias("text"), F.when(new, F.length("kept_text")).otherwise(F.col("row.n_chars")).alias("n_chars"),
        *(F.col(f"row.{c}") for c in rest),
    )
    return cut.select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole: copies of a row are equal in all columns.

    A document without words, null and empty texts among them, brings none to the mix and goes, as do documents that
    the mix takes no copy of.  A null source is a source of its own, last in order.  Rows that repeat share the
    copies that they are given together.  No rows give no rows.
    """
    mixed = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
    mixed = mixed.agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version"))
    found = docs.join(mixed, same)
    # Rows that repeat each other share their copies.
    place = F.row_number().over(Window.partitionBy("_id", "_version").orderBy("_rows"))
    extra = (F.col("_place") <= F.col("_copies") % F.col("_rows")).cast("long")
    found = found.withColumn("_place", place).withColumn("_own", F.floor(F.col("_copies") / F.col("_rows")) + extra)
    return found.where("_own > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_own")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, with digests of the ids and of the text they decode to.

    Null texts are encoded as empty ones, which have no ids; repeated rows, and rows without an id, give a row each.
    """
    encoded = bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))
    return encoded.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = staged(function(spark, docs, sf_dir), name)
    return docs
