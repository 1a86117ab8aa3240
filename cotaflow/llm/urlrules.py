"""URL filters: given rules by host and path, and rules mined from labelled URLs.

A URL becomes a handful of tokens: scheme, top-level domain, site, leftmost further label, first directory, file
ending and first argument, one of each kind at most.  Spark's FP-growth finds the combinations that are
frequent among all URLs, with the label as one more token where there is one.  A combination that most URLs
with it carry a label for is a rule; unlabelled URLs count against it.  Rules that a shorter one makes
needless are pruned, the rest match URLs by an inverted index from token to rules.

With at most seven tokens a URL has 128 combinations at most, so a least support s leaves no more than
128 / s frequent ones, whatever the table: that bound holds for the rules and for the index.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotaflow.llm.hotjoin import join_back
from cotaflow.sources.scratch import staged

LEAST_SUPPORT, LEAST_CONFIDENCE = 0.01, 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label:"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and all hosts below it where the path begins with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the test query.
RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both '' where it is null or has no ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The tokens of a URL, one of each kind at most, in a fixed order."""
    labels = F.split(host, r"\.")
    directories = F.filter(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda d: d != "")
    arguments = F.regexp_extract(url, r"^[^?#]*\?([^#&=]+)", 1)
    kinds = {
        "scheme": F.translate(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), UPPER, LOWER),
        "tld": F.element_at(labels, -1),
        "site": F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))),
        "sub": F.when(F.size(labels) > 2, F.get(labels, F.lit(0))),
        "dir": F.try_element_at(directories, F.lit(1)),
        "ext": F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1),
        "arg": arguments,
    }
    named = F.array(*(F.when(value != "", F.concat(F.lit(f"{kind}:"), value)) for kind, value in kinds.items()))
    return F.when(host != "", F.filter(named, lambda t: t.isNotNull())).otherwise(F.array().cast("array<string>"))


def given_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host`` and ``path`` in one string, and its verdict; null without one."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path)):
        fits = rule.fits(host, path)
        name = F.when(fits, rule.host + rule.path) if name is None else name.when(fits, rule.host + rule.path)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name, verdict)


def mine(
    labelled: DataFrame, token_col: str = "tokens", label_col: str = "label", support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE
) -> DataFrame:
    """(tokens, verdict, rows, confidence): rules from frequent token combinations to a label.

    ``labelled`` has an array of distinct tokens and a label, null where there is none, for each URL.  A rule's
    combination with its label is in at least ``support`` of all rows, and the label is on at least
    ``confidence`` of the rows with the combination, those without a label included.  A rule goes if one with some
    of its tokens has the same verdict and at least its confidence.  Without labels there are no rules.
    """
    spark = labelled.sparkSession
    items = labelled.select(
        F.when(F.col(label_col).isNull(), F.col(token_col)).otherwise(F.concat(F.col(token_col), F.array(F.concat(F.lit(LABEL), label_col)))).alias("items")
    )
    if labelled.where(F.col(label_col).isNotNull()).isEmpty():
        return spark.createDataFrame([], "tokens array<string>, verdict string, rows long, confidence double")
    found = FPGrowth(itemsCol="items", minSupport=support).fit(items).freqItemsets
    split = found.select(
        F.array_sort(F.filter("items", lambda t: ~t.startswith(LABEL))).alias("tokens"),
        F.get(F.filter("items", lambda t: t.startswith(LABEL)), F.lit(0)).alias("label"),
        F.col("freq").alias("rows"),
    )
    split = staged(split, "frequent-tokens")
    before = split.where("label is null").select("tokens", F.col("rows").alias("all_rows"))
    rules = split.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).join(before, "tokens")
    rules = rules.withColumn("confidence", F.col("rows") / F.col("all_rows")).where(F.col("confidence") >= confidence)
    rules = rules.select("tokens", F.substring("label", len(LABEL) + 1, 1 << 20).alias("verdict"), "rows", "confidence")
    rules = staged(rules, "rules")
    # All combinations of some of a rule's tokens; a rule has seven at most.
    some = F.aggregate(
        "tokens",
        F.array(F.array().cast("array<string>")),
        lambda have, token: F.concat(have, F.transform(have, lambda one: F.array_append(one, token))),
    )
    shorter = rules.select("tokens", "verdict", "confidence", F.explode(some).alias("part")).where(F.size("part") < F.size("tokens"))
    rival = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("other"))
    needless = shorter.join(rival, ["part", "verdict"]).where("other >= confidence").select("tokens", "verdict").distinct()
    return staged(rules.join(needless, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "rows", "confidence"), "kept-rules")


def matches(token_sets: DataFrame, rules: DataFrame, token_col: str = "tokens") -> DataFrame:
    """(tokens, mined, mined_verdict, confidence): the best rule for each distinct token set that one fits.

    The most confident rule is best, then the one with more rows, with fewer tokens, of the smaller name and
    verdict.  ``rules`` is what ``mine`` gives; its number is bounded by the least support.
    """
    numbered = rules.select(F.struct("tokens", "verdict").alias("rule"), "tokens", "rows", "confidence")
    index = numbered.select(F.explode("tokens").alias("token"), "rule", F.size("tokens").alias("size"), "rows", "confidence")
    posted = token_sets.select(F.col(token_col).alias("own"), F.explode(token_col).alias("token")).join(F.broadcast(index), "token")
    fitting = posted.groupBy("own", "rule", "size", "rows", "confidence").agg(F.count("*").alias("met")).where("met = size")
    order = F.struct(
        (-F.col("confidence")).alias("c"), (-F.col("rows")).alias("r"), "size", F.concat_ws(" ", "rule.tokens").alias("name"), F.col("rule.verdict").alias("verdict")
    )
    best = fitting.groupBy("own").agg(F.min(order).alias("best"))
    return best.select(
        F.col("own").alias(token_col), F.col("best.name").alias("mined"), F.col("best.verdict").alias("mined_verdict"), (-F.col("best.c")).alias("confidence")
    )


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    label: Column | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    support: float = LEAST_SUPPORT,
    confidence: float = LEAST_CONFIDENCE,
) -> DataFrame:
    """(id, host, path, rule, verdict, mined, confidence) of each row of ``pages``.

    A given rule decides where one fits, the longest if several do.  Other URLs go by the best mined rule, or
    get ``default``.  Rules are mined from ``label``, a column of ``pages`` that is null for unlabelled rows;
    without it, the verdicts of the given rules are the labels, so that what they imply is carried over to URLs
    that they just miss, such as a port behind the host.

    Null URLs and those without ``://`` have an empty host and path, no tokens and the default verdict.  URLs
    that repeat count each time in mining and are judged alike; null ids stay.  No rows give no rows.  Other
    columns are ignored.
    """
    url = F.col(url_col)
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"), (F.lit(None) if label is None else label).cast("string").alias("given"))
    name, verdict = given_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": name, "ruled": verdict, "tokens": tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))}).drop("url")
    found = mine(rows.withColumn("label", F.col("ruled") if label is None else F.col("given")), support=support, confidence=confidence)
    sets = staged(rows.groupBy("tokens").agg(F.count("*").alias("copies")), "token-sets")
    best = staged(sets.join(matches(sets, found), "tokens", "left"), "token-verdicts")
    joined = join_back(rows, best, "tokens", "copies")
    mined = F.col("rule").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", "mined_verdict", F.lit(default)).alias("verdict"),
        F.when(mined, F.col("mined")).alias("mined"),
        F.when(mined, F.col("confidence")).alias("confidence"),
    )
