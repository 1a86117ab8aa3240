"""How the sources of a language differ in their words: a frequent-pattern tree over term rows.

A term's row lists, in the order of sources, the sources that use it and the rate it has there.  For a pair of
sources the difference summed over all terms is what each source's rates make against the other's rate for
absent terms, plus a correction for each term that both use.  Corrections come from the tree: rows are put in
in source order, equal ones at once with their number, so rows that begin alike share a path, and a pair is
corrected once for a node and each of its ancestors, times the rows that pass through the node.

Rows are sorted over the cluster, so a path's rows lie side by side; each task grows the tree of one batch at a
time from how far a row agrees with the one before.  A tree cut at the end of a batch only has some nodes
twice, which does not change a sum.  All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotaflow.llm import flat
from cotaflow.session import ship_package
from cotaflow.sources.scratch import Staging, staged

#: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``
TERMS = flat._is_word([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Rates are whole numbers of this unit, and each count has PRIOR added.
UNIT, PRIOR = 1_000_000_000, 2
#: A term is kept in a language where so many of its documents hold it.
LEAST_DOCUMENTS = 10
#: Parts in which the sources of a language meet each other.
PARTS = 16
#: Node and ancestor pairs that a task takes at a time, and pair sums it keeps before it hands them on.
AT_ONCE = 1 << 20
#: Bytes of text that are counted at a time.
SLICE = 8 << 20


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as lower-cased strings."""
    sizes = ends - starts
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])
    letters = data[at]
    letters = np.where((letters >= ord("A")) & (letters <= ord("Z")), letters + 32, letters).astype(np.uint8)
    buffers = [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())]
    return pa.Array.from_buffers(pa.large_string(), len(starts), buffers).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group of a slice of texts."""
    for batch in flat.slices(batches, "text", SLICE):
        words = flat.Words(batch.column("text"), TERMS, lower=True)
        if not len(words.hashes):
            continue
        names = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
        codes = [n.indices.to_numpy().astype(np.int64) for n in names]
        _, group_row, group = np.unique(codes[0] * (len(names[1].dictionary) + 1) + codes[1], return_index=True, return_inverse=True)
        _, first, term = np.unique(words.hashes, return_index=True, return_inverse=True)
        document = words.document()
        order = np.sort((term * len(group_row) + group[document]) * batch.num_rows + document)
        cell = order // batch.num_rows
        new_cell = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        new_document = np.concatenate(([True], order[1:] != order[:-1])).astype(np.int64)
        cell = cell[new_cell]
        columns = [batch.column(c).take(pa.array(group_row[cell % len(group_row)])) for c in ("lang", "source")]
        terms = _terms(words.data, words.starts[first], words.ends[first]).take(pa.array(cell // len(group_row)))
        counts = [np.diff(np.append(new_cell, len(order))), np.add.reduceat(new_document, new_cell)]
        yield pa.RecordBatch.from_arrays(
            [*columns, terms, *(pa.array(c.astype(np.int64)) for c in counts)], names=["lang", "source", "term", "uses", "documents"]
        )


def term_counts(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, uses, documents) of every term of every group; nulls are ''."""
    ship_package(documents.sparkSession)
    chosen = documents.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))),
        F.col(text_col).alias("text"),
    )
    counted = chosen.mapInArrow(_counted, "lang string, source string, term string, uses long, documents long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("documents").alias("documents"))


def rate(uses: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (uses + PRIOR) / (total + PRIOR terms)); 1 where there are no terms."""
    exact = (f"cast({x} as decimal(20,0))" for x in (f"{uses} + {PRIOR}", f"{total} + {PRIOR} * {terms}"))
    above, below = exact
    return F.expr(f"case when {terms} > 0 then 1 + cast({UNIT} as decimal(10,0)) * {above} div {below} else 1L end")


def difference(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)), symmetric in both."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class PairSums:
    """Sums of whole numbers by language and two sources, folded whenever many are waiting."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys.append(keys)
        self.values.append(values)
        self.waiting += len(keys)
        if self.waiting > 2 * AT_ONCE:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, values = np.concatenate(self.keys), np.concatenate(self.values)
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        keys, values = keys[new], np.add.reduceat(values, new) if len(new) else values
        self.keys, self.values, self.waiting = [keys], [values], len(keys)
        return keys, values


def tree_nodes(paths: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the prefix tree of sorted paths: where a node's path begins, where its own item stands, and the rows through it.

    ``paths`` holds the items of all paths one after the other, path i from ``bounds[i]`` to ``bounds[i + 1]``,
    equal items as equal numbers; ``rows`` says how often each path occurs.  A path brings a node for each
    item beyond what it has in common with the path before; the node ends with the first later path that
    has less in common with its forerunner than the node's depth.
    """
    sizes = np.diff(bounds)
    shared = np.zeros(len(sizes), np.int64)  # items that a path has in common with the one before
    open_paths = np.arange(1, len(sizes))
    depth = 0
    while len(open_paths):
        open_paths = open_paths[(sizes[open_paths] > depth) & (sizes[open_paths - 1] > depth)]
        open_paths = open_paths[paths[bounds[open_paths] + depth] == paths[bounds[open_paths - 1] + depth]]
        depth += 1
        shared[open_paths] = depth
    through = np.concatenate(([0], np.cumsum(rows)))
    starts, items, weights = [], [], []
    for depth in range(int(sizes.max(initial=0))):
        breaks = np.flatnonzero(shared <= depth)
        ends = np.append(breaks[1:], len(sizes))
        own = sizes[breaks] > depth
        starts.append(bounds[breaks[own]])
        items.append(bounds[breaks[own]] + depth)
        weights.append(through[ends[own]] - through[breaks[own]])
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(items), np.concatenate(weights)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pair corrections of the trees of one task: (lang, a, b, value) with a before b."""
    names: dict[tuple[str, str], int] = {}
    sums = PairSums()

    def handed_on() -> pa.RecordBatch:
        keys, values = sums.fold()
        known = list(names)
        left, right = keys >> 32, keys & 0xFFFFFFFF
        columns = [[known[k][0] for k in left], [known[k][1] for k in left], [known[k][1] for k in right]]
        sums.__init__()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(values)], names=["lang", "a", "b", "value"])

    for batch in batches:
        if not batch.num_rows:
            continue
        items = batch.column("items")
        bounds = items.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        fields = items.flatten()
        sizes = np.diff(bounds)
        langs = batch.column("lang").dictionary_encode()
        sources = fields.field("source").dictionary_encode()
        pairs = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes) << 32 | sources.indices.to_numpy().astype(np.int64)
        distinct, group = np.unique(pairs, return_inverse=True)
        lang_names, source_names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
        number = [names.setdefault((lang_names[g >> 32], source_names[g & 0xFFFFFFFF]), len(names)) for g in distinct]
        group = np.array(number, np.int64)[group] if len(number) else group
        p, absent = fields.field("p").to_numpy(), fields.field("absent").to_numpy()
        same = np.unique(np.stack((group, p)), axis=1, return_inverse=True)[1].ravel() if len(p) else np.zeros(0, np.int64)
        starts, own, weights = tree_nodes(same, bounds, batch.column("rows").to_numpy())
        ancestors = own - starts
        i = 0
        done = np.concatenate(([0], np.cumsum(ancestors)))
        while i < len(own):
            j = max(i + 1, int(np.searchsorted(done, done[i] + AT_ONCE, "right")) - 1)
            node = np.repeat(np.arange(i, j), ancestors[i:j])
            if len(node):
                above = starts[node] + np.arange(len(node)) - (done[node] - done[i])
                below = own[node]
                value = _difference(p[above], p[below]) - _difference(p[above], absent[below])
                value += _difference(absent[above], absent[below]) - _difference(absent[above], p[below])
                sums.add(group[above] << 32 | group[below], value * weights[node])
            i = j
        if sums.waiting > AT_ONCE and len(sums.fold()[0]) > AT_ONCE:
            yield handed_on()
    if sums.waiting:
        yield handed_on()


def _mirrored(source: str, other: str, value: str) -> Column:
    return F.struct(F.col(source).alias("source"), F.col(other).alias("other"), F.col(value).alias("value"))


def audit(
    documents: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = 10,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and in which terms.

    Terms are runs of letters A-Z, lower-cased, and of all signs beyond ASCII; a language keeps those that at
    least ``least_documents`` of its rows hold.  A kept term has a rate in every group of language and source
    and in the language, and two rates p and q differ by floor((p - q)^2 / (p + q)).  Part ``pair`` sums the
    differences to each other source of the language over all kept terms, 0 without any; part ``term``
    has the ``top_terms`` terms of a group whose rate is above the language's.  Ranks go by value, ties by the
    item's bytes.

    Null languages, sources and texts count as ''.  Rows that repeat count each time.  A group without terms is
    in part ``pair``; the only source of a language has no pair; no rows give no rows.  A term's row is as long as its
    language has sources, whose square the result has anyway.  Other columns are ignored.
    """
    spark = documents.sparkSession
    with Staging(spark) as stage:
        cells = stage(term_counts(documents, text_col, lang_col, source_col), "term-counts")
        languages = cells.groupBy("lang", "term").agg(F.sum("uses").alias("lang_uses"), F.sum("documents").alias("documents"))
        languages = stage(languages.where(F.col("documents") >= least_documents).drop("documents"), "kept-terms")
        sizes = languages.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_uses").alias("lang_total"))
        kept = stage(cells.drop("documents").join(languages, ["lang", "term"]), "kept-counts")
        totals = kept.groupBy("lang", "source").agg(F.sum("uses").alias("total"), F.count("*").alias("present"))
        groups = documents.select(
            *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))
        ).distinct()
        groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0)
        groups = stage(groups.withColumn("zero", F.lit(0).cast("long")).withColumn("absent", rate("zero", "total", "terms")).drop("zero"), "groups")
        rated = stage(kept.join(groups, ["lang", "source"]).withColumn("p", rate("uses", "total", "terms")), "rates")

        # What each source's rates make against the other source's rate for absent terms.
        base = groups.select("lang", "source", "absent", F.col("absent").alias("p"), (F.col("terms") - F.col("present")).alias("rows"), "terms")
        present = rated.groupBy("lang", "source", "absent", "p").agg(F.count("*").alias("rows"))
        profile = base.unionByName(present.withColumn("terms", F.lit(0).cast("long")))
        profile = profile.withColumn("part", F.pmod(F.xxhash64("source", "p"), F.lit(PARTS)))
        others = groups.select("lang", F.col("source").alias("other"), F.col("absent").alias("other_absent"))
        others = others.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        met = profile.join(others, ["lang", "part"]).where("source <> other").withColumn("f", difference("p", "other_absent"))
        there = met.groupBy("lang", "source", "other").agg(
            F.sum(F.expr("(rows - terms) * f")).alias("value"), F.sum(F.expr("rows * f")).alias("back")
        )
        both = there.select(
            "lang",
            F.explode(F.array(F.struct("source", "other", "value"), _mirrored("other", "source", "back"))).alias("one"),
        ).select("lang", "one.*")

        rows = rated.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "absent"))).alias("items"))
        rows = rows.groupBy("lang", "items").agg(F.count("*").alias("rows")).where(F.size("items") > 1)
        rows = rows.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items")
        corrections = rows.mapInArrow(_corrections, "lang string, a string, b string, value long")
        corrections = corrections.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        sides = F.explode(F.array(_mirrored("a", "b", "value"), _mirrored("b", "a", "value"))).alias("one")
        corrections = corrections.select("lang", sides).select("lang", "one.*")

        pairs = both.unionByName(corrections).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
        own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pairs.withColumnRenamed("other", "item").withColumn("rank", F.row_number().over(own)).withColumn("part", F.lit("pair"))
        terms = rated.withColumn("q", rate("lang_uses", "lang_total", "terms")).where("p > q")
        terms = terms.select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))
        terms = terms.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
        return staged(pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank"), "divergence")
