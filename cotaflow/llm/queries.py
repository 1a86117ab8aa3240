"""The operators applied to the test tables, one query each, and SQL twins where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotaflow.llm import bpe, crosspolytope, divergence, licenses, maxmatch, mixing, neardup, quality, search, substring, toxicity, urlrules, whitening
from cotaflow.llm.sql import ORACLES as ORACLES
from cotaflow.sources.scratch import staged


def tokenizer_path(name: str) -> str:
    """The path of a public tokenizer's file on the driver."""
    return importlib.import_module("public_tokenizers").path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 50, by its whole text."""
    docs = _table(spark, sf_dir, "documents")
    found = search.top_k(docs, docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"))
    return found.withColumn("score", F.round("score", 6))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the held-out third (remainder 1) are not learned from."""
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    described = staged(quality.describe(docs), "statistics")
    model = quality.fit(described, labels.where(_remainder(3) != 1), "quality")
    scored = quality.score(described, model)
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxmatch.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fifth (remainder 0) are not learned from."""
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels.where(_remainder(5) != 0), "toxic")
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted", "n_matches")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return crosspolytope.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))[0]


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector, a row each."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)
    found = found.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "identity_error", "explained", F.posexplode("whitened"))
    explained = F.get("explained", F.col("pos"))
    return found.select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col").alias("whitened"), explained.alias("explained"), "identity_error"
    )


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of given rules; URLs that none fits go by combinations mined from those that one does."""
    return urlrules.judge(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bm25_search": bm25_search,
    "op2_quality_classifier": quality_classifier,
    "op3_token_counts": token_counts,
    "op4_toxicity": toxicity_scores,
    "op5_minhash_near_dedup": near_duplicates,
    "op6_bpe_encode_decode": bpe_round_trip,
    "op7_substring_dedup": substring_dedup,
    "op8_cross_polytope": nearest_vectors,
    "op9_license_scan": license_scan,
    "op10_source_mix": source_mix,
    "op11_whitening": whitened_embeddings,
    "op12_source_divergence": source_divergence,
    "op13_url_filter": url_filter,
}
