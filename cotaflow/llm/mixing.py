"""Mixing sources to target weights by entropy balancing.

Wanted are rates for documents, as close as can be to 1 in relative entropy per word, such that the words of
each group come to its target: minimise the sum of size * (r log r - r + 1) under one constraint a group, for
one or several ways of grouping.  The dual is convex and its solution is an exponential tilt: a document's rate
is exp of the sum of its groups' multipliers.  Documents with the same groups share a rate, so the corpus is
summed once into cells.  With one grouping the Hessian is diagonal, so each group takes all its damped Newton steps in
one expression over the table of groups; several groupings take turns, each iteration a Spark aggregation over cells.
Multipliers stay in tables; only the largest miss goes to the driver.

Rates become copies: the whole part for each document, and one more for documents in the order of a hash of
id and text until the cell's words are used up.  The order is found through sums of 4096 hash buckets a cell,
so only the bucket in which the words run out is looked at row by row.  Rows that repeat each other are counted
first and handed their copies together, however many they are.  What a large document that no longer fits
leaves over is filled with smaller ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotaflow.operators.prefix import numbered
from cotaflow.sources.scratch import Staging, staged

MOST_ITERATIONS = 100
TOLERANCE = 1e-9
BUCKETS = 4096
#: Rows of a group of repeated rows that one task writes at a time.
PIECE = 10_000
#: After the first pass, each further one fills what is left with documents of at most this share of it, which may
#: then have a copy more than their rate says.
FILLS = (0.25, 0.25, 0.5)


def word_count(text: str) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(totals: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target): the total shared by weight 1, 2, 3, 1, ... of sources in order, null last.

    No target passes ``cap`` times its source's size; what is cut off goes to the others by weight, until
    none is above.  The level per weight of the sources below their cap rises from round to round; each round is a
    sum over the sources, which are numbered by ranges, so there may be as many sources as documents.
    """
    weighed = numbered(totals.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "_number")
    weighed = weighed.select(
        "source", "source_size", ((F.col("_number") - 1) % 3 + 1).cast("double").alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")
    )
    everything, free = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (everything or 0) / (free or 1), 0
    while True:
        above = F.col("most") < F.col("weight") * level
        words, free, n = weighed.agg(F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == capped:
            break
        level, capped = (everything - words) / free if free else math.inf, n
    return weighed.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def balance(cells: DataFrame, targets: dict[str, DataFrame], stage: Staging) -> DataFrame:
    """``cells`` (the grouping columns and ``words``) with a column ``rate``.

    ``targets`` gives for each grouping column a table of its values and their ``target``.  Values without
    words, and values without a target row, keep the multiplier 0.
    """
    if len(targets) == 1:
        return _balance_apart(cells, *next(iter(targets.items())), stage)
    state = cells.withColumn("tilt", F.lit(0.0))
    for _ in range(MOST_ITERATIONS):
        worst = 0.0
        for column, wanted in targets.items():
            sums = state.groupBy(column).agg(F.sum(F.col("words") * F.exp("tilt")).alias("mass"))
            goal = wanted.select(F.col(column).alias("_value"), "target")
            gap = (F.col("target") - F.col("mass")) / F.col("mass")
            # The gradient over the curvature, cut to one so that a far start does not overshoot.
            step = F.when(F.col("target") <= 0, F.lit(-1e3)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), gap)))
            miss = F.when(F.col("target") > 0, F.abs(gap))
            steps = sums.join(goal, F.col(column).eqNullSafe(F.col("_value"))).where("mass > 0")
            steps = steps.select("_value", step.alias("_step"), miss.alias("_miss"))
            joined = state.join(steps, F.col(column).eqNullSafe(F.col("_value")), "left")
            state = joined.withColumn("tilt", F.col("tilt") + F.coalesce("_step", F.lit(0.0)))
            state = stage(state.select(*cells.columns, "tilt", F.col("_miss").alias("miss")), "tilts")
            worst = max(worst, state.agg(F.max("miss")).first()[0] or 0.0)
            state = state.drop("miss")
        if worst <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"the targets can't be met together: after {MOST_ITERATIONS} steps one is missed by a share of {worst:.3g}")
    return state.withColumn("rate", F.exp("tilt")).drop("tilt")


def _balance_apart(cells: DataFrame, column: str, wanted: DataFrame, stage: Staging) -> DataFrame:
    """``balance`` for one grouping: groups don't meet, so each takes all its Newton steps by itself, in one pass."""
    sums = cells.groupBy(F.col(column).alias("_value")).agg(F.sum("words").alias("mass")).where("mass > 0")
    goal = wanted.select(F.col(column).alias("_goal"), "target")
    pairs = sums.join(goal, F.col("_value").eqNullSafe(F.col("_goal")))

    def gap(tilt: Column) -> Column:
        return F.col("target") / (F.col("mass") * F.exp(tilt)) - 1

    def stepped(tilt: Column, _: Column) -> Column:
        return tilt + F.least(F.lit(1.0), F.greatest(F.lit(-1.0), gap(tilt)))

    newton = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_ITERATIONS)), F.lit(0.0), stepped)
    pairs = pairs.withColumn("_tilt", F.when(F.col("target") <= 0, F.lit(-1e3)).otherwise(newton))
    pairs = stage(pairs.select("_value", "_tilt", F.when(F.col("target") > 0, F.abs(gap(F.col("_tilt")))).alias("miss")), "tilts")
    worst = pairs.agg(F.max("miss")).first()[0] or 0.0
    if worst > TOLERANCE:
        raise RuntimeError(f"the targets can't be met: after {MOST_ITERATIONS} steps one is missed by a share of {worst:.3g}")
    found = cells.join(pairs.drop("miss"), F.col(column).eqNullSafe(F.col("_value")), "left")
    return found.select(*cells.columns, F.exp(F.coalesce("_tilt", F.lit(0.0))).alias("rate"))


def _fill(rows: DataFrame, need: DataFrame, cell: str, share: float | None, cap: float) -> DataFrame:
    """Rows (cell, size, order, n, base, more) in which further rows get a copy, up to the words that ``need`` lacks.

    Each is a group of ``n`` rows that repeat each other, which have ``more`` copies beyond ``base`` each in all.
    ``share`` limits the size of such rows to that part of what is lacking; without it each row gets its first
    copy beyond ``base``.
    """
    lacking = need.select(F.col(cell).alias("_cell"), "lack")
    open_rows = rows.join(lacking, F.col(cell).eqNullSafe(F.col("_cell"))).drop("_cell")
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("lack") * (share if share is not None else 1.0) + 1e-6)
    fits = fits & (F.col("more") == 0) if share is None else fits
    left = F.col("n") * F.floor(F.lit(cap) - F.col("base")) - F.col("more")
    room = F.when(fits, F.greatest(F.lit(0), F.least("n", left))).otherwise(0)
    open_rows = open_rows.withColumn("_room", room.cast("long")).withColumn("_bucket", F.shiftrightunsigned("order", 52))
    words = F.col("size") * F.col("_room")
    sums = open_rows.where("_room > 0").groupBy(cell, "_bucket").agg(F.sum(words).alias("_words"))
    before = Window.partitionBy(cell).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    sums = sums.select(F.col(cell).alias("_cell"), F.col("_bucket").alias("_in"), "_before", "_words")
    same = F.col(cell).eqNullSafe(F.col("_cell")) & (F.col("_bucket") == F.col("_in"))
    open_rows = open_rows.join(sums, same, "left").drop("_cell", "_in")
    whole = (F.col("_room") > 0) & (F.col("_before") + F.col("_words") <= F.col("lack") + 1e-6)
    partly = (F.col("_room") > 0) & ~whole & (F.col("_before") <= F.col("lack"))
    running = Window.partitionBy(cell, "_bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, 0)
    unused = F.col("lack") + 1e-6 - (F.col("_before") + F.sum(words).over(running) - words)
    given = F.greatest(F.lit(0), F.least(F.col("_room"), F.floor(unused / F.col("size"))))
    last = open_rows.where(partly).withColumn("more", F.col("more") + given)
    rest = open_rows.where(~partly | partly.isNull()).withColumn("more", F.col("more") + F.when(whole, F.col("_room")).otherwise(0))
    return rest.select(*rows.columns).union(last.select(*rows.columns))


def round_to_copies(rows: DataFrame, cell: str, cap: float, stage: Staging) -> DataFrame:
    """``rows`` (cell, size, rate, order, n) with ``all_copies``, of all ``n`` rows: near ``rate`` times each cell's words in all."""
    state = rows.withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("more", F.lit(0).cast("long"))
    have = F.col("size") * (F.col("n") * F.col("base") + F.col("more"))
    for share in (None, *FILLS):
        need = state.groupBy(cell).agg((F.sum(F.col("size") * F.col("n") * F.col("rate")) - F.sum(have)).alias("lack"))
        state = stage(_fill(state, stage(need, "need"), cell, share, cap), "copies")
    return state.withColumn("all_copies", (F.col("n") * F.col("base") + F.col("more")).cast("long")).drop("base", "more")


def one_by_one(groups: DataFrame) -> DataFrame:
    """A row for each of the ``n`` rows of a group, with its part ``copies`` of ``all_copies``: equal but for one copy.

    Large groups are cut into ``PIECE`` rows first, which go to different tasks.
    """
    whole, extra = F.floor(F.col("all_copies") / F.col("n")), F.col("all_copies") % F.col("n")
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))
    small = groups.where(F.col("n") <= PIECE).withColumn("_piece", F.lit(0).cast("long"))
    large = groups.where(F.col("n") > PIECE).withColumn("_piece", F.explode(pieces)).repartition("order", "_piece")
    first = F.col("_piece") * PIECE
    places = F.sequence(first + 1, F.least(first + PIECE, F.col("n")))
    found = small.union(large).withColumn("_place", F.explode(places))
    return found.withColumn("copies", (whole + (F.col("_place") <= extra).cast("long")).cast("long"))


def mix(documents: DataFrame, cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken, version) of each row of ``documents``.

    Size is the number of words of the text.  Sources, ordered by code point with null as a source of its own
    at the end, weigh 1, 2, 3, repeating, and share the corpus's words by ``capped_targets``.  ``copies`` is
    the number of times the mix takes the row, at most ``cap``, ``taken`` its words, repeats
    counted; ``version`` is a hash of the text, to tell rows of one id apart.  Reruns agree.  Null and empty
    texts have size 0; a source without words has the target 0.  Rows that repeat each other are taken alike
    or in part.  No rows give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    version = F.xxhash64(F.col(text_col))
    with Staging(spark) as stage:
        sized = stage(
            documents.select(
                F.col(id_col).alias("doc_id"),
                F.col(source_col).alias("source"),
                word_count(text_col).alias("size"),
                version.alias("version"),
                F.xxhash64(F.lit(20), F.col(id_col), version).alias("order"),
            )
            .groupBy("doc_id", "source", "size", "version", "order")
            .agg(F.count(F.lit(1)).alias("n")),
            "sizes",
        )
        totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
        targets = stage(capped_targets(totals, cap), "targets")
        cells = targets.select("source", F.col("source_size").alias("words"))
        rates = balance(cells, {"source": targets}, stage)
        shares = rates.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        shares = shares.select("_source", "source_size", "target", F.least("rate", F.lit(float(cap))).alias("rate"))
        rows = sized.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        mixed = one_by_one(round_to_copies(rows, "source", cap, stage))
        taken = (F.col("size") * F.col("copies")).alias("taken")
        return staged(mixed.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", taken, "version"), "mix")
