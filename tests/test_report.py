import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from glycospan.functions import ranges
from glycospan.operators import report
from tests.conftest import START


def status(spark, values, metric, **options):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    col = ranges.range_status(F.col("v"), metric, **options)
    return [r.s for r in df.select("i", col.alias("s")).orderBy("i").collect()]


def test_holes_between_integer_bounds(spark):
    assert status(spark, [120, 120.5, 121], "Average Glucose") == ["Excellent", "Critical High", "Good"]
    assert status(spark, [120.5], "Average Glucose", continuous=True) == ["Excellent"]
    assert status(spark, [5.65], "HbA1c Equivalent") == ["Critical High"]


def test_outside_the_ranges(spark):
    assert status(spark, [65, 401], "Random Glucose") == ["Low", "Critical High"]
    assert status(spark, [65, 401], "no such metric") == ["Low", "Critical High"]


@hyp(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(0, 500), min_size=1, max_size=20))
def test_first_range_wins(spark, values):
    for metric in ("Fasting Glucose", "Average Glucose", "HbA1c Equivalent"):
        table = ranges.ranges_of(metric)
        want = []
        for v in values:
            found = [s for s, lo, hi in table if lo <= v <= hi]
            want.append(found[0] if found else "Low" if v < table[0][1] else "Critical High")
        assert status(spark, values, metric) == want


def test_lights_and_severity(spark):
    df = spark.createDataFrame([(float(v),) for v in (100, 130, 170, 300, 500)], "v double")
    got = df.select(
        ranges.light_colour(F.col("v"), "Average Glucose").alias("c"),
        ranges.light_status(F.col("v"), "Average Glucose").alias("s"),
    ).collect()
    assert [r.c for r in got] == ["green", "orange", "orange", "red", "red"]
    assert got[-1].s == "Critical"
    words = spark.createDataFrame([(w,) for w in ("Good", "Prediabetes", "Low", None)], "w string")
    assert [r[0] for r in words.select(ranges.severity(F.col("w"))).collect()] == [
        "normal",
        "warning",
        "high",
        None,
    ]


def test_report_of_a_small_forecast(spark):
    values = [60.0, 100.0, 140.0, 200.0]
    forecast = spark.createDataFrame(
        [(1, START + dt.timedelta(hours=i), v, v - 5, v + 5, v, True) for i, v in enumerate(values)]
        + [(1, START - dt.timedelta(hours=1), 300.0, 300.0, 300.0, 300.0, False)],
        "patient_id long, timestamp timestamp, predicted_glucose double, lower_bound double, "
        "upper_bound double, trend double, is_future boolean",
    )
    metrics = report.report_metrics(report.report_input(forecast))
    m = metrics.first()
    assert (m.n, m.average, m.minimum, m.maximum) == (4, 125.0, 60.0, 200.0)
    assert (m.first_prediction, m.last_prediction) == (60.0, 200.0)
    assert (m.in_range, m.below_range, m.above_range) == (50.0, 25.0, 25.0)
    assert m.hba1c == pytest.approx((125 + 46.7) / 28.7)
    assert m.period == "4 hours"
    rows = {r.parameter: r for r in report.report_rows(metrics).collect()}
    assert len(rows) == 7
    assert rows["Average Glucose"].status == "Good"
    assert rows["Minimum Predicted"].status == "Low"
    assert rows["Minimum Predicted"].severity == "high"
    assert rows["Time in Range (70-180)"].status == "Needs Improvement"
    assert rows["Time Above Range (>180)"].status == "High"
    assert rows["Average Glucose"].reference_range.startswith("Excellent: 70-120, Good: 121-154")


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.25,), (0.35,)], "v double")
    assert [r[0] for r in df.select(F.bround("v", 1)).collect()] == [0.2, 0.4]


def test_period_label(spark):
    df = spark.createDataFrame([(167,), (168,), (191,)], "n long")
    assert [r[0] for r in df.select(ranges.period_label(F.col("n"))).collect()] == [
        "167 hours",
        "7 days",
        "7 days",
    ]
