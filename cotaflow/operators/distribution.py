"""Exact quartiles, fences, box-plot statistics and density curves per group."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotaflow.functions.missing import present
from cotaflow.functions.ordered_bits import with_ordered_bits
from cotaflow.operators.joins import lookup_join
from cotaflow.sources.scratch import staged

# Half width, in ranks, of the band that is searched for an exact quantile, and the sketch accuracy.
BAND = 0.0005
ACCURACY = 10_000

# Most distinct values of one band that a task ranks, and into how many parts a larger one is cut.
PIECE_VALUES = 2_000_000
SPLIT = 64


def group_stats(
    df: DataFrame,
    by: list[str],
    value: str,
    probs: dict[str, float],
    method: str = "select",
) -> DataFrame:
    """``n``, ``low``, ``high``, ``sd`` and the named quantiles of ``value`` per group.

    Missing values and NaN are left out; a group of nothing else keeps its row, with ``n`` 0.
    Quantiles interpolate linearly between neighbours (type 7).  ``method`` is ``"radix"`` (exact, for
    groups of any size and number, in four reads of the values, which are written to the shared folder once),
    ``"select"`` (exact, for few large groups; runs jobs), ``"builtin"`` (Spark's exact percentile,
    which keeps the distinct values of a group in one task) or ``"approx"``.
    """
    x = F.col(value)
    rows = df.select(*by, F.when(present(x), x.cast("double")).alias(value))
    shape = [
        F.count(value).alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.stddev_samp(value).alias("sd"),
    ]
    if method in ("builtin", "approx"):
        points = F.array(*[F.lit(p) for p in probs.values()])
        pick = F.percentile(x, points) if method == "builtin" else F.percentile_approx(x, points, ACCURACY)
        found = rows.groupBy(*by).agg(*shape, pick.alias("__q"))
        named = [F.col("__q")[i].alias(name) for i, name in enumerate(probs)]
        return found.select(*by, "n", "low", "high", "sd", *named)
    if method == "radix":
        return _radix_quantiles(rows, by, value, probs, shape)
    if method != "select":
        raise ValueError(f"unknown method {method!r}")
    return _select_quantiles(rows, by, value, probs, shape)


#: Bits of a key that each pass of radix selection counts by, from the top.
DIGITS = (22, 21, 21)


def _radix_quantiles(rows: DataFrame, by: list[str], value: str, probs: dict[str, float], shape: list[Column]) -> DataFrame:
    """Exact quantiles by counting: a fixed number of passes, whatever the values and the groups.

    Values become whole numbers of 64 bits in the same order.  The first pass counts the rows of each group by
    the topmost digit; the digit whose rows hold a wanted rank is that of the wanted value.  Each further
    pass counts, by the next digit, only rows that begin like a wanted value.  A pass shuffles counts, at
    most 2^22 for each group and rank, summed by the tasks before; the rows of a large group stay where they are.
    """
    keyed = staged(with_ordered_bits(rows, value, "__key"), "quantile-keys")
    known = keyed.where(F.col("__key").isNotNull()).select(*by, value, "__key")
    summary = keyed.groupBy(*by).agg(*shape)

    def digit(level: int) -> Column:
        """The key's leading bits down to this digit; the sign is the first one's."""
        return F.shiftright("__key", 64 - sum(DIGITS[:level]))

    # The first pass has all ranks of a group in one row each; ranks count from 0.
    wanted = {name: (F.col("__n") - 1) * F.lit(p) for name, p in probs.items()}
    ends = [F.struct(F.lit(f"{side}{i}").alias("q"), near(at).cast("long").alias("rank")) for i, at in enumerate(wanted.values()) for side, near in (("lo", F.floor), ("hi", F.ceil))]
    counts = known.groupBy(*by, digit(1).alias("__digit")).agg(F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(*by)
    counts = counts.withColumn("__n", F.sum("__rows").over(whole)).withColumn("__before", F.coalesce(F.sum("__rows").over(_up_to_digit(by)), F.lit(0)))
    counts = counts.withColumn("__want", F.explode(F.array(*ends))).select(*by, "__digit", "__rows", "__before", "__want.*")
    for level in range(2, len(DIGITS) + 1):
        found = _at_rank(counts, by).withColumnsRenamed({"__digit": "__prefix"})
        beginning = known.withColumn("__prefix", digit(level - 1))
        met = lookup_join(beginning, found, [*by, "__prefix"], "inner", nulls_match=True)
        last = [F.min(value).alias("__value")] if level == len(DIGITS) else []
        counts = met.groupBy(*by, "q", "rank", digit(level).alias("__digit")).agg(F.count(F.lit(1)).alias("__rows"), *last)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(_up_to_digit([*by, "q"])), F.lit(0)))
    held = counts.where((F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__rows")))
    names = [f"{side}{i}" for i in range(len(probs)) for side in ("lo", "hi")]
    values = held.groupBy(*by).agg(*[F.max(F.when(F.col("q") == q, F.col("__value"))).alias(f"__{q}") for q in names])
    # Each group has one row of either kind, so the largest value of a column is the one that is there.
    both = summary.unionByName(values, allowMissingColumns=True).groupBy(*by)
    joined = both.agg(*[F.max(c).alias(c) for c in ("n", "low", "high", "sd", *(f"__{q}" for q in names))])
    quantiles = [
        _between(F.col(f"__lo{i}"), F.col(f"__hi{i}"), (F.col("n") - 1) * F.lit(p)).alias(name) for i, (name, p) in enumerate(probs.items())
    ]
    return joined.select(*by, "n", "low", "high", "sd", *quantiles)


def _up_to_digit(inside: list[str]) -> Window:
    """The counts of lower digits, of which a group has 2^22 at most."""
    return Window.partitionBy(*inside).orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)


def _at_rank(counts: DataFrame, by: list[str]) -> DataFrame:
    """The digit that holds each wanted rank, with the rank among the rows of that digit."""
    held = counts.where((F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__rows")))
    return held.select(*by, "q", (F.col("rank") - F.col("__before")).alias("rank"), "__digit")


def _between(lo: Column, hi: Column, at: Column) -> Column:
    """The value at a fractional rank; an exact hit takes the value as it is, so an infinity does not turn into NaN."""
    part = at - F.floor(at)
    return F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi)


def _select_quantiles(
    rows: DataFrame, by: list[str], value: str, probs: dict[str, float], shape: list[Column]
) -> DataFrame:
    """Exact quantiles without gathering a group in one place.

    A mergeable sketch proposes cut points a hair below and above each quantile.  Counting the rows
    between the cut points tells exactly which band holds each wanted rank; only the values of those
    bands, about a thousandth of a group, go on.  A band of still too many values is cut again, and in
    the end the values of a band are ranked.  The cut points only set how much work is left: the
    counts are exact, so the result is, whatever the sketch says.

    ``rows`` is read three times, so stage it first if it is dear to compute.  What each step finds is
    small and is written to the shared folder: its size is then known, and rows meet it by broadcast,
    here and in the steps that follow, instead of being shuffled by group.
    """
    cuts = sorted({min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-BAND, BAND)})
    marks = _with_cuts(rows.groupBy(*by).agg(*shape, _cut_points(value, cuts)), len(cuts), "quantile-marks")
    known = rows.where(F.col(value).isNotNull())
    banded = lookup_join(known, marks.drop("n", "low", "high", "sd"), by, "inner", nulls_match=True).select(
        *by, value, _band(value, len(cuts)).alias("__band")
    )

    # Ranks from 0 that the quantiles need.
    ranks = {}
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(p)
        ranks[f"__lo_{name}"] = F.floor(at)
        ranks[f"__hi_{name}"] = F.ceil(at)
    counts = banded.groupBy(*by, "__band").agg(F.count(F.lit(1)).alias("__rows"))
    ranked = lookup_join(counts, marks.select(*by, "n"), by, "inner", nulls_match=True).withColumns(ranks)
    ranked = ranked.withColumn("__before", _rows_before(by)).withColumn("__piece", F.col("__band").cast("bigint"))
    targets = staged(_holding(ranked, ranks).select(*by, "__piece", "__before", *ranks), "quantile-bands")

    pieces = banded.withColumnRenamed("__band", "__piece")
    cells = lookup_join(pieces, targets.select(*by, "__piece"), [*by, "__piece"], "inner", nulls_match=True)
    cells = staged(cells.groupBy(*by, "__piece", value).agg(F.count(F.lit(1)).alias("__rows")), "quantile-values")
    size = _largest_piece(cells, by)
    while size > PIECE_VALUES:
        cells, targets = _cut_again(cells, targets, by, value, list(ranks))
        size, last = _largest_piece(cells, by), size
        if size >= last:  # distinct values always part at the sketch's cut points
            raise RuntimeError(f"a band of {size} distinct values could not be cut")

    up_to = (
        Window.partitionBy(*by, "__piece").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = lookup_join(cells, targets, [*by, "__piece"], "inner", nulls_match=True).withColumn(
        "__end", F.col("__before") + F.sum("__rows").over(up_to)
    )
    found = placed.groupBy(*by).agg(
        *[
            F.max(F.when((F.col(r) < F.col("__end")) & (F.col(r) >= F.col("__end") - F.col("__rows")), F.col(value)))
            .alias(f"__at{r}")
            for r in ranks
        ]
    )
    joined = lookup_join(marks.select(*by, "n", "low", "high", "sd"), found, by, "left", nulls_match=True)
    quantiles = [
        _between(F.col(f"__at__lo_{name}"), F.col(f"__at__hi_{name}"), (F.col("n") - 1) * F.lit(p)).alias(name)
        for name, p in probs.items()
    ]
    return staged(joined.select(*by, "n", "low", "high", "sd", *quantiles), "quantiles")


def _cut_points(value: str, shares: list[float]) -> Column:
    return F.percentile_approx(value, F.array(*[F.lit(s) for s in shares]), F.lit(ACCURACY)).alias("__cuts")


def _with_cuts(df: DataFrame, cuts: int, label: str) -> DataFrame:
    """``df`` staged with each cut point in a column of its own, which is quicker to compare with."""
    return staged(df.withColumns({f"__cut{i}": F.col("__cuts")[i] for i in range(cuts)}).drop("__cuts"), label)


def _band(value: str, cuts: int) -> Column:
    """Number of cut points below the value."""
    return sum((F.when(F.col(f"__cut{i}") < F.col(value), 1).otherwise(0) for i in range(cuts)), F.lit(0))


def _rows_before(inside: list[str]) -> Column:
    """Rows in the bands below, among the few bands of a group."""
    w = Window.partitionBy(*inside).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("__rows").over(w), F.lit(0))


def _holding(bands: DataFrame, ranks: Iterable[str]) -> DataFrame:
    """The bands that hold a wanted rank."""
    first, end = F.col("__before"), F.col("__before") + F.col("__rows")
    return bands.where(reduce(Column.__or__, [(F.col(r) >= first) & (F.col(r) < end) for r in ranks]))


def _largest_piece(cells: DataFrame, by: list[str]) -> int:
    sizes = cells.groupBy(*by, "__piece").agg(F.count(F.lit(1)).alias("values"))
    return sizes.agg(F.coalesce(F.max("values"), F.lit(0))).first()[0]


def _cut_again(
    cells: DataFrame, targets: DataFrame, by: list[str], value: str, ranks: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Split every piece by its distinct values and keep the parts that hold a wanted rank."""
    inside = [*by, "__piece"]
    shares = [i / SPLIT for i in range(1, SPLIT)]
    cuts = _with_cuts(cells.groupBy(*inside).agg(_cut_points(value, shares)), len(shares), "quantile-cuts")
    banded = lookup_join(cells, cuts, inside, "inner", nulls_match=True).select(
        *inside, value, "__rows", _band(value, len(shares)).alias("__band")
    )
    counts = banded.groupBy(*inside, "__band").agg(F.sum("__rows").alias("__rows"))
    counts = counts.withColumn("__below", _rows_before(inside))
    placed = lookup_join(counts, targets, inside, "inner", nulls_match=True)
    placed = placed.withColumn("__before", F.col("__before") + F.col("__below"))
    part = F.col("__piece") * SPLIT + F.col("__band")
    kept = staged(_holding(placed, ranks).select(*by, part.alias("__piece"), "__before", *ranks), "quantile-bands")
    parts = banded.select(*by, part.alias("__piece"), value, "__rows")
    left = lookup_join(parts, kept.select(*inside), inside, "inner", nulls_match=True)
    return staged(left, "quantile-values"), kept


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
SIDES = {"q1": 0.25, "q3": 0.75}


def fences(df: DataFrame, by: list[str], value: str, method: str = "select") -> DataFrame:
    """Per group the quartiles, their distance and the limits 1.5 distances beyond them."""
    return (
        group_stats(df, by, value, SIDES, method)
        .select(*by, "q1", "q3")
        .withColumn("iqr", F.col("q3") - F.col("q1"))
        .withColumn("lower", F.col("q1") - 1.5 * F.col("iqr"))
        .withColumn("upper", F.col("q3") + 1.5 * F.col("iqr"))
    )


def within_fences(df: DataFrame, by: list[str], value: str, method: str = "select") -> DataFrame:
    """Rows inside their group's fences, limits included, with the fences attached."""
    limits = fences(df, by, value, method)
    joined = lookup_join(df, limits, by, "inner", nulls_match=True)
    return joined.where(F.col(value).between(F.col("lower"), F.col("upper")))


def box_stats(df: DataFrame, by: list[str], value: str, method: str = "select") -> DataFrame:
    """Box-plot numbers per group: ``n``, quartiles and whiskers.

    The whiskers end at the outermost values within 1.5 quartile distances of the box.
    """
    quartiles = group_stats(df, by, value, QUARTILES, method).select(*by, "n", *QUARTILES)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    rows = lookup_join(df.where(present(F.col(value))).select(*by, value), quartiles, by, "inner", nulls_match=True)
    return rows.groupBy(*by, "n", *QUARTILES).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
    )


def _curve_shape(df: DataFrame, by: list[str], value: str, points: int, method: str) -> DataFrame:
    """``n``, ends and bandwidth of each group with two rows or more."""
    if points < 2:
        raise ValueError("a curve needs at least two points")
    spread = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)
    base = F.coalesce(
        F.nullif(spread, F.lit(0.0)), F.nullif(F.col("sd"), F.lit(0.0)), F.nullif(F.abs("low"), F.lit(0.0)), F.lit(1.0)
    )
    return (
        group_stats(df, by, value, SIDES, method)
        .where(F.col("n") >= 2)
        .select(*by, "n", "low", "high", (0.9 * base * F.pow("n", F.lit(-0.2))).alias("bandwidth"))
    )


def density_curve(df: DataFrame, by: list[str], value: str, points: int = 512, method: str = "select") -> DataFrame:
    """Gaussian density of each group at evenly spaced points from its lowest to its highest value.

    The bandwidth is the rule-of-thumb one: 0.9 times the smaller of standard deviation and quartile
    distance / 1.34, times n to the power -1/5.  Where that is zero the standard deviation, the size
    of the value or 1 take its place in turn.  Groups of one row have no curve.
    Each row adds to ``points`` sums inside its own task; only the sums are shuffled.  ``binned_density`` is
    for groups with many more rows than points.
    """
    x = F.col(value)
    shape = _curve_shape(df, by, value, points, method)
    rows = lookup_join(df.where(present(x)).select(*by, x), shape, by, "inner", nulls_match=True)
    step = (F.col("high") - F.col("low")) / (points - 1)
    # Per row only its distance from the first point and the distance of two points, both in bandwidths, go on.
    away = ((F.col("low") - x) / F.col("bandwidth")).alias("__away")
    rows = rows.select(*by, away, (step / F.col("bandwidth")).alias("__step"))
    grid = rows.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    gap = F.col("__away") + F.col("point") * F.col("__step")
    sums = grid.groupBy(*by, "point").agg(F.sum(F.exp(-0.5 * gap * gap)).alias("mass"))
    scale = F.col("n") * F.col("bandwidth") * F.sqrt(F.lit(2) * F.pi())
    placed = lookup_join(sums, shape, by, "inner", nulls_match=True)
    at = F.col("low") + F.col("point") * step
    return placed.select(*by, "point", at.alias("at"), "bandwidth", (F.col("mass") / scale).alias("density"))


def binned_density(df: DataFrame, by: list[str], value: str, points: int = 512, method: str = "radix") -> DataFrame:
    """``density_curve`` by linear binning: work of n + points^2 a group in place of n * points.

    Every row adds to the two points beside it, by how near it is to either; the Gaussian is then applied to these
    weights.  With points d bandwidths apart, that differs from the exact density by at most
    d^2 / (8 bandwidth sqrt(2 pi)) anywhere: what linear interpolation of the Gaussian can miss.
    Of a large group only its weights, one for each point and task, are shuffled.
    """
    x = F.col(value)
    shape = _curve_shape(df, by, value, points, method)
    rows = lookup_join(df.where(present(x)).select(*by, x), shape, by, "inner", nulls_match=True)
    step = (F.col("high") - F.col("low")) / (points - 1)
    place = F.when(step > 0, F.least((x - F.col("low")) / step, F.lit(points - 1.0))).otherwise(0.0)
    left = F.floor(F.col("__place"))
    beside = F.array(
        F.struct(left.alias("bin"), (1 - (F.col("__place") - left)).alias("weight")),
        F.struct((left + 1).alias("bin"), (F.col("__place") - left).alias("weight")),
    )
    weights = rows.select(*by, place.alias("__place")).select(*by, F.explode(beside).alias("__one")).where("__one.weight > 0")
    weights = weights.groupBy(*by, F.col("__one.bin").alias("__bin")).agg(F.sum("__one.weight").alias("__weight"))
    binned = lookup_join(weights, shape, by, "inner", nulls_match=True)
    grid = binned.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    gap = (F.col("__bin") - F.col("point")) * step / F.col("bandwidth")
    sums = grid.groupBy(*by, "point", "n", "low", "high", "bandwidth").agg(F.sum(F.col("__weight") * F.exp(-0.5 * gap * gap)).alias("mass"))
    scale = F.col("n") * F.col("bandwidth") * F.sqrt(F.lit(2) * F.pi())
    at = F.col("low") + F.col("point") * step
    return sums.select(*by, "point", at.alias("at"), "bandwidth", (F.col("mass") / scale).alias("density"))
