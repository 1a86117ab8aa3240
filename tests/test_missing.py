import math

import pytest
from pyspark.sql import functions as F

from cotaflow.functions import missing


@pytest.fixture
def amounts(frame):
    return frame("g string, x double", ("gap", 1.0), ("gap", None), ("none", None), ("full", 1.0), ("full", 2.0))


@pytest.mark.parametrize(
    "rule, expected",
    [
        (missing.strict_sum, {"gap": None, "none": None, "full": 3.0}),
        (missing.skip_sum, {"gap": 1.0, "none": None, "full": 3.0}),
        (missing.zero_sum, {"gap": 1.0, "none": 0.0, "full": 3.0}),
    ],
)
def test_sums(amounts, rule, expected):
    assert dict(amounts.groupBy("g").agg(rule(F.col("x"))).collect()) == expected


@pytest.mark.parametrize("rule", [missing.strict_sum, missing.skip_sum, missing.zero_sum])
def test_sum_of_sums_is_the_sum(amounts, rule):
    wider = amounts.withColumn("h", F.substring("g", 1, 1))
    direct = dict(wider.groupBy("h").agg(rule(F.col("x"))).collect())
    parts = wider.groupBy("g", "h").agg(rule(F.col("x")).alias("x"))
    assert dict(parts.groupBy("h").agg(rule(F.col("x"))).collect()) == direct


def test_compounding(frame):
    rates = frame("r double", (1.0,), (1.0,), (1.0,))
    assert rates.agg(missing.compound(F.col("r"))).first()[0] == pytest.approx(3.0301)
    gap = frame("r double", (1.0,), (None,))
    found = gap.agg(missing.compound(F.col("r")), missing.strict_compound(F.col("r"))).first()
    assert found[0] == pytest.approx(1.0) and found[1] is None


def test_finite_and_present(frame):
    values = frame("x double", (1.0,), (None,), (math.nan,), (math.inf,), (-math.inf,))
    assert values.where(missing.finite(F.col("x"))).count() == 1
    assert values.where(missing.present(F.col("x"))).count() == 3


def test_not_in_keeps_missing(frame):
    values = frame("x string", ("a",), ("b",), (None,))
    assert values.where(missing.not_in(F.col("x"), ["a"])).count() == 2
    assert values.where(~F.col("x").isin(["a"])).count() == 1
