"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotaflow.sources.scratch import Staging

#: Rounds shrink the longest path to a half at least, so this is out of reach.
MOST_ROUNDS = 200


def components(edges: DataFrame, stage: Staging) -> DataFrame:
    """(node, component): the smallest node that each end of an edge can reach.

    ``edges`` has the long columns a and b.  Alternates two steps until only stars are left: every node hands
    its larger neighbours to the smallest one, then its smaller ones.  Each step is an aggregation and a
    join on the node, whose hot keys the adaptive planner splits; each round is written to the shared
    folder, so a lost executor costs one round.  Loops and repeated edges do no harm; no edges give no rows.
    """
    links = stage(_tidy(edges), "links")
    rounds = 0
    while not _settled(links):
        if rounds == MOST_ROUNDS:
            raise RuntimeError("components did not settle")
        links = stage(_small_star(_large_star(links)), "links")
        rounds += 1
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(links.select("b", "b").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, its larger end first."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every link ends at the centre of a star: no node has two smaller ones, or one that has one itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = links.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v > u
    return larger.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    smaller = links.select(F.col("a").alias("u"), F.col("b").alias("v"))  # v < u
    handed = smaller.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _tidy(handed.union(least.select("u", "m")))
