"""The site's own tables: job entries and the listing of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.functions.labels import ONGOING
from cotaflow.functions.text import word_count
from cotaflow.operators.ranking import page

# Reading speed and label of the listing.
WORDS_PER_MINUTE = 200
EVERYTHING = "Tudo"


def job_table(entries: DataFrame, section: str = "profissional") -> DataFrame:
    """Entries of one section, keyed by institution, an open end shown as ongoing.

    Write it partitioned by ``institution`` for one table each.
    """
    chosen = entries.where((F.col("section") == section) & F.col("institution").isNotNull()).drop("section")
    return chosen.withColumn("end", F.coalesce(F.col("end").cast("string"), F.lit(ONGOING)))


def listing_page(posts: DataFrame, ties: list[str], size: int, number: int = 0) -> DataFrame:
    """One page of posts, newest first."""
    return page(posts, "dt", ties, size, number)


def category_counts(posts: DataFrame, everything: str = EVERYTHING) -> DataFrame:
    """Posts per category and in all.  ``categories`` is an array; a category named twice counts once."""
    named = F.explode(F.concat(F.array(F.lit(everything)), F.coalesce(F.array_distinct("categories"), F.array())))
    return posts.select(named.alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def in_category(posts: DataFrame, category: str) -> DataFrame:
    """Posts that carry the category."""
    return posts.where(F.array_contains("categories", category))


def reading_time(posts: DataFrame) -> DataFrame:
    """Words and minutes of reading per post."""
    counted = posts.withColumn("words", word_count(F.col("text")))
    return counted.withColumn("minutes", F.ceil(F.col("words") / WORDS_PER_MINUTE))
