import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotaflow.functions.ordered_bits import with_ordered_bits
from cotaflow.operators import distribution as dist
from tests.conftest import rows

EXACT = ["builtin", "select", "radix"]


@pytest.mark.parametrize("method", EXACT)
def test_textbook_quartiles(frame, method):
    values = frame("x double", (1.0,), (2.0,), (4.0,), (9.0,), (None,), (math.nan,))
    found = dist.group_stats(values.withColumn("g", F.lit("a")), ["g"], "x", dist.QUARTILES, method).first()
    assert (found.n, found.low, found.q1, found.median, found.q3, found.high) == (4, 1.0, 1.75, 3.0, 5.25, 9.0)


def sample(seed):
    """Groups of many shapes: skewed, tied, constant, single, empty, and a missing key."""
    r = random.Random(seed)
    data = [("big", i % 2, r.gauss(0, 1)) for i in range(20000)]
    data += [("tied", 0, float(r.choice([1, 1, 1, 1, 2, 50]))) for _ in range(3000)]
    data += [("heavy", 0, math.exp(r.gauss(0, 6))) for _ in range(2500)]
    data += [("same", 0, 3.0)] * 500 + [("one", 0, -2.5), ("two", 1, 1.0), ("two", 1, 2.0), ("empty", 0, None)]
    data += [(None, None, float(i)) for i in range(101)] + [("ends", 0, x) for x in (-math.inf, 1.0, 2.0, 3.0, math.inf)]
    r.shuffle(data)
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_equals_sorting(spark, seed):
    data = sample(seed)
    df = spark.createDataFrame(data, "k string, j int, x double").repartition(7)
    probs = {"p0": 0.0, "p1": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p999": 0.999, "p100": 1.0}
    found = {(r.k, r.j): r for r in dist.group_stats(df, ["k", "j"], "x", probs, "select").collect()}
    groups = {}
    for k, j, x in data:
        groups.setdefault((k, j), []).append(x)
    assert found.keys() == groups.keys()
    for key, values in groups.items():
        values = sorted(v for v in values if v is not None)
        assert found[key].n == len(values)
        for name, p in probs.items():
            if not values:
                assert found[key][name] is None
                continue
            at = (len(values) - 1) * p
            lo, hi = values[math.floor(at)], values[math.ceil(at)]
            part = at - math.floor(at)
            want = lo if lo == hi else (1 - part) * lo + part * hi
            assert found[key][name] == pytest.approx(want, rel=1e-12, nan_ok=True), (key, name)


@pytest.mark.parametrize("accuracy", [4, 10_000])
def test_bands_of_many_values_are_cut_again(spark, monkeypatch, accuracy):
    monkeypatch.setattr(dist, "PIECE_VALUES", 12)
    monkeypatch.setattr(dist, "SPLIT", 8)
    monkeypatch.setattr(dist, "BAND", 0.05)
    monkeypatch.setattr(dist, "ACCURACY", accuracy)
    df = spark.createDataFrame(sample(4), "k string, j int, x double").where("k is null or k != 'ends'")
    by, calls, again = ["k", "j"], [], dist._cut_again
    monkeypatch.setattr(dist, "_cut_again", lambda *a: calls.append(1) or again(*a))
    cut = dist.group_stats(df, by, "x", dist.QUARTILES, "select").select(*by, "n", *dist.QUARTILES)
    exact = dist.group_stats(df, by, "x", dist.QUARTILES, "builtin").select(*by, "n", *dist.QUARTILES)
    assert len(calls) > 1
    for a, b in zip(rows(cut), rows(exact), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])


def test_selection_does_not_rely_on_the_sketch(spark, monkeypatch):
    """Cut points from a very rough sketch cost time, not exactness."""
    monkeypatch.setattr(dist, "ACCURACY", 4)
    df = spark.createDataFrame(sample(3), "k string, j int, x double").where("k is null or k != 'ends'")
    by = ["k", "j"]
    rough = dist.group_stats(df, by, "x", dist.QUARTILES, "select").select(*by, "n", *dist.QUARTILES)
    exact = dist.group_stats(df, by, "x", dist.QUARTILES, "builtin").select(*by, "n", *dist.QUARTILES)
    for a, b in zip(rows(rough), rows(exact), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])


def test_default_is_the_method_for_any_size(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"))
    small = dist.group_stats(df, ["g"], "x", dist.QUARTILES, "builtin")
    large = dist.group_stats(df, ["g"], "x", dist.QUARTILES)
    assert " percentile(" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert rows(small) == rows(large)


def test_approximate_quantiles_are_close(spark):
    df = spark.range(100000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"))
    found = dist.group_stats(df, ["g"], "x", dist.QUARTILES, "approx").first()
    assert found.median == pytest.approx(50000, abs=50)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        dist.group_stats(spark.range(1).withColumn("x", F.lit(1.0)), ["id"], "x", dist.QUARTILES, "guess")


@pytest.mark.parametrize("method", EXACT)
def test_fences_keep_their_limits(frame, method):
    values = frame("g int, x double", *[(1, float(x)) for x in (1, 2, 3, 4, 5, 8, 100, -50)])
    found = dist.within_fences(values, ["g"], "x", method)
    q1, q3 = np.percentile([1, 2, 3, 4, 5, 8, 100, -50], [25, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert sorted(r.x for r in found.collect()) == [x for x in (1, 2, 3, 4, 5, 8) if low <= x <= high]
    on_the_fence = frame("g int, x double", *[(1, x) for x in (0.0, 2.0, 4.0, 6.0, 8.0, 14.0)])
    assert dist.within_fences(on_the_fence, ["g"], "x", method).count() == 6


@pytest.mark.parametrize("method", EXACT)
def test_box_stats(frame, method):
    data = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 40.0, -30.0]
    found = dist.box_stats(frame("g int, x double", *[(1, x) for x in data], (1, None)), ["g"], "x", method).first()
    assert (found.n, found.whisker_low, found.whisker_high) == (8, 1.0, 6.0)
    assert [found.q1, found.median, found.q3] == pytest.approx(list(np.percentile(data, [25, 50, 75])))


@pytest.mark.parametrize("method", EXACT)
def test_density_against_direct_formula(frame, method):
    r = random.Random(5)
    data = {1: [r.gauss(0, 2) for _ in range(60)], 2: [1.0, 4.0], 3: [7.0], 4: [2.0, 2.0, 2.0, 2.0, 9.0], 5: [3.0, 3.0]}
    df = frame("g int, x double", *[(g, x) for g, xs in data.items() for x in xs])
    found = {}
    for row in dist.density_curve(df, ["g"], "x", 9, method).collect():
        found.setdefault(row.g, {})[row.point] = row
    assert set(found) == {1, 2, 4, 5}
    for g, curve in found.items():
        x = np.array(data[g])
        iqr = np.subtract(*np.percentile(x, [75, 25]))
        sd = x.std(ddof=1)
        base = min(sd, iqr / 1.34) or sd or abs(x[0]) or 1.0
        h = 0.9 * base * len(x) ** -0.2
        grid = np.linspace(x.min(), x.max(), 9)
        want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
        assert [curve[i].bandwidth for i in range(9)] == pytest.approx([h] * 9)
        assert [curve[i].at for i in range(9)] == pytest.approx(list(grid))
        assert [curve[i].density for i in range(9)] == pytest.approx(list(want))


def test_ordered_bits(spark):
    """The bits of every kind of double, as the hardware has them."""
    rng = np.random.default_rng(1)
    powers = [2.0**k for k in range(-1074, 1024)]
    some = rng.integers(0, 2**63, 20_000, dtype=np.uint64).view(np.float64)
    beside = [np.nextafter(p, to) for p in powers for to in (0, np.inf)]
    x = np.concatenate([some, -some, powers, beside, [0.0, -0.0, np.inf, -np.inf, -5e-324, 1.7976931348623157e308, np.nan]])
    df = spark.createDataFrame(pa.table({"x": pa.array(x)}))
    got = with_ordered_bits(df, "x", "k").toArrow().to_pydict()
    bits = np.array(got["x"]).view(np.int64)
    want = np.where(bits < 0, -(bits & np.int64(2**63 - 1)), bits)
    assert got["k"] == [None if np.isnan(v) else w for v, w in zip(got["x"], want.tolist(), strict=True)]


def test_radix_selection_spreads_a_hot_group(spark):
    """The shuffles of a group with all rows carry counts, not rows, and equal what numpy finds."""
    df = spark.range(200_000).select((F.col("id") % 7 == 9).alias("g"), F.round(F.randn(3) * 50, 1).alias("x"))
    found = dist.group_stats(df, ["g"], "x", dist.QUARTILES, "radix")
    x = df.toPandas().x.to_numpy()
    row = found.first()
    assert [row.q1, row.median, row.q3] == pytest.approx(list(np.percentile(x, [25, 50, 75])))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan
    assert plan.count("partial_count") >= len(dist.DIGITS)


@pytest.mark.parametrize("points", [4, 64, 512])
def test_binned_density_is_within_its_bound(frame, points):
    r = random.Random(points)
    data = {1: [r.gauss(0, 2) for _ in range(300)], 2: [1.0, 4.0], 3: [7.0], 4: [2.0, 2.0, 2.0, 9.0], 5: [3.0, 3.0], None: [1.0, 2.0, None, 5.0]}
    df = frame("g int, x double", *[(g, x) for g, xs in data.items() for x in xs])
    exact = {(row.g, row.point): row for row in dist.density_curve(df, ["g"], "x", points).collect()}
    found = {(row.g, row.point): row for row in dist.binned_density(df, ["g"], "x", points).collect()}
    assert found.keys() == exact.keys() and len(found) == 5 * points
    for key, row in found.items():
        gap = (exact[key[0], 1].at - exact[key[0], 0].at) / row.bandwidth
        bound = gap**2 / (8 * row.bandwidth * math.sqrt(2 * math.pi))
        assert row.at == pytest.approx(exact[key].at) and abs(row.density - exact[key].density) <= bound + 1e-12
