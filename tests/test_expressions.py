import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cotaflow.functions import labels, measures, periods, report, text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_ids_keep_leading_zeros(spark):
    marked = F.lit("00.123.456/0001-90")
    assert one(spark, text.digits_only(marked)) == "00123456000190"
    assert one(spark, text.drop_marks(marked)) == "00123456000190"
    assert one(spark, text.drop_marks(F.lit("A-1 b"))) == "A1 b"


@pytest.mark.parametrize(
    "name, short",
    [
        ("Multimercados Livre", "Livre"),
        ("Multimercados  Long and Short", "Long and Short"),
        ("Outros", "Outros"),
        ("Fundo Multimercados Macro", "Fundo Multimercados Macro"),
        (None, None),
    ],
)
def test_short_name(spark, name, short):
    assert one(spark, text.short_name(F.lit(name).cast("string"), "Multimercados")) == short


def test_paste_writes_missing_as_text(spark):
    assert one(spark, text.paste(F.lit(2010), F.lit(None).cast("string"), sep="-")) == "2010-NA"


@pytest.mark.parametrize("flag, mirror, feeder", [(None, "Não", "Sim"), ("N", "Não", "Não"), ("S", "Sim", "Sim")])
def test_structure_labels(spark, flag, mirror, feeder):
    value = F.lit(flag).cast("string")
    assert one(spark, labels.mirror_label(value)) == mirror
    assert one(spark, labels.feeder_label(value)) == feeder


@pytest.mark.parametrize("flag, label", [("S", "Sim"), ("N", "Não"), ("?", "?"), (None, None)])
def test_fee_label(spark, flag, label):
    assert one(spark, labels.fee_label(F.lit(flag).cast("string"))) == label


@pytest.mark.parametrize("value, lumped", [("a", "a"), ("z", "Outros"), (None, "Outros")])
def test_lump(spark, value, lumped):
    assert one(spark, labels.lump(F.lit(value).cast("string"), ["a", "b"])) == lumped


def test_quarters(spark):
    d = F.lit(dt.date(2020, 5, 3))
    assert one(spark, periods.quarter_label(d)) == "2020 T2" == periods.quarter_label_of(2020, 2)
    assert one(spark, periods.quarter_start(d)) == dt.date(2020, 4, 1)
    assert one(spark, periods.month_start(F.lit(2020), F.lit(5))) == dt.date(2020, 5, 1)


def test_period_filters_include_both_ends(frame):
    days = frame(
        "d date", *[(dt.date.fromisoformat(x),) for x in ("2009-12-31", "2010-01-01", "2010-03-31", "2011-12-31", "2012-01-01")]
    )
    d = F.col("d")
    assert days.where(periods.in_years(d, 2010, 2011)).count() == 3
    assert days.where(periods.in_quarters(d, (2010, 1), (2010, 1))).count() == 2
    assert days.where(periods.in_quarters(d, (2010, 1), (2011, 4))).count() == 3
    by_label = periods.quarter_label(d).between(periods.quarter_label_of(2010, 1), periods.quarter_label_of(2011, 4))
    assert days.where(by_label).count() == 3


def test_dated_sequence_sorts_by_day_then_number(spark, frame):
    """Any day and any long; a missing one comes first and is not passed over."""
    days = [None, dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2024, 5, 1), dt.date(9999, 12, 31)]
    numbers = [None, -(2**63), -1, 0, 7, 2**63 - 1]
    table = frame("d date, n bigint", *[(d, n) for d in days for n in numbers])
    packed = periods.dated_sequence(F.col("d"), F.col("n"))
    assert [tuple(r) for r in table.orderBy(packed).collect()] == [(d, n) for d in days for n in numbers]
    assert one(spark, periods.dated_sequence(F.lit(None).cast("date"), F.lit(1))) is not None


def test_number_from_text(spark):
    assert one(spark, periods.number_from_text(F.lit("08"))) == 8
    assert one(spark, periods.number_from_text(F.lit("x8"))) is None


@pytest.mark.parametrize(
    "first, last, ieee, null",
    [
        (2.0, 3.0, 50.0, 50.0),
        (0.0, 5.0, math.inf, None),
        (0.0, -5.0, -math.inf, None),
        (None, 5.0, None, None),
        (5.0, None, None, None),
        (0.0, None, None, None),
    ],
)
def test_growth(spark, first, last, ieee, null):
    a, b = F.lit(first).cast("double"), F.lit(last).cast("double")
    assert one(spark, measures.growth_pct(a, b)) == ieee
    assert one(spark, measures.growth_pct(a, b, "null")) == null


def test_growth_zero_by_zero_is_nan(spark):
    assert math.isnan(one(spark, measures.growth_pct(F.lit(0.0), F.lit(0.0))))
    assert math.isnan(one(spark, measures.growth_pct(F.lit(0.0), F.lit(math.nan))))


@pytest.mark.parametrize(
    "x, out", [(51.0, True), (-51.0, True), (50.0, False), (math.nan, False), (None, False), (math.inf, True)]
)
def test_beyond(spark, x, out):
    assert one(spark, measures.beyond(F.lit(x).cast("double"), 50)) is out


def test_formats(spark):
    assert one(spark, report.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, report.percent(F.lit(51.456))) == "51.46%"
    assert one(spark, report.reais_billions(F.lit(-3.14159))) == "R$ -3.14 bi"
    assert [one(spark, report.axis_percent(F.lit(x))) for x in (0.5, 1.5, -2.4)] == ["0%", "2%", "-2%"]


def test_reading_time_of_the_published_posts(frame):
    words = frame("words bigint", (5537,), (7652,), (6168,), (8856,))
    minutes = words.select(F.ceil(F.col("words") / 200)).collect()
    assert [m[0] for m in minutes] == [28, 39, 31, 45]
