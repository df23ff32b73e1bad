import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospan.operators import patterns


def test_peak_tie_takes_the_smaller_hour(make_hourly):
    rows = make_hourly([(1, 3, 150), (1, 9, 150), (1, 4, 80), (1, 11, 80)])
    got = patterns.peak_and_trough(patterns.hour_profile(rows), "hour").first()
    assert (got.peak_hour, got.trough_hour) == (3, 4)


def test_trend_matches_polyfit(waves):
    got = patterns.linear_trend(waves).where("patient_id = 1").first()
    y = waves.where("patient_id = 1").toPandas().sort_values("hour_ts")["glucose"].to_numpy()
    slope, intercept = np.polyfit(np.arange(len(y)), y, 1)
    assert got.slope == pytest.approx(slope) and got.intercept == pytest.approx(intercept)
    assert got.direction == ("increasing" if slope > 0 else "decreasing")


def test_trend_is_null_when_a_value_is_missing(make_hourly):
    got = patterns.linear_trend(make_hourly([(1, 0, 1), (1, 1, None), (1, 2, 3)])).first()
    assert got.slope is None and got.direction is None


def test_constant_series_has_slope_zero(make_hourly):
    got = patterns.linear_trend(make_hourly([(1, h, 100) for h in range(5)])).first()
    assert got.slope == 0 and got.direction == "decreasing"


def test_range_limits_are_inside(make_hourly):
    rows = make_hourly([(1, 0, 70), (1, 1, 180), (1, 2, 69.9), (1, 3, 180.1), (1, 4, None)])
    got = patterns.time_in_range(rows).first()
    assert (got.total_hours, got.below_hours, got.in_range_hours, got.above_hours) == (5, 1, 2, 1)
    assert got.in_range_percent == pytest.approx(40)


def test_histogram_matches_numpy(waves):
    got = patterns.histogram(waves, 40).where("patient_id = 2").orderBy("bin").collect()
    y = waves.where("patient_id = 2").toPandas()["glucose"]
    counts, edges = np.histogram(y, 40)
    assert [r.n for r in got] == list(counts)
    np.testing.assert_allclose([r.bin_low for r in got], edges[:-1])


def test_histogram_of_one_value(make_hourly):
    got = patterns.histogram(make_hourly([(1, h, 100) for h in range(6)]), 4).collect()
    assert sum(r.n for r in got) == 6 and len(got) == 4


def test_box_plot(make_hourly):
    values = [10, 11, 12, 13, 14, 15, 16, 100]
    got = patterns.box_plot(make_hourly([(1, h, v) for h, v in enumerate(values)])).first()
    q1, q3 = np.percentile(values, [25, 75])
    assert (got.q1, got.q3) == (q1, q3)
    assert (got.whisker_low, got.whisker_high, got.outliers) == (10, 16, 1)


def test_diversity(spark, make_hourly):
    rows = make_hourly([(1, 168 * w, 100 + w) for w in range(4)])
    got = patterns.slot_diversity(rows, "glucose", "hour_ts").first()
    assert got.weeks == 4 and got.std_glucose == pytest.approx(np.std([100, 101, 102, 103]))
    flat = patterns.hourly_diversity(rows, "glucose", "hour_ts").first()
    assert flat.mean_distinct_values == pytest.approx(4 / 24)


def test_horizons_are_prefixes(make_hourly):
    rows = make_hourly([(1, h, h) for h in range(10)]).withColumn("step", F.hour("hour_ts") + 1)
    got = patterns.compare_horizons(rows, {"three": 3, "all": 10}, "glucose")
    got = {r.period: r for r in got.collect()}
    assert (got["three"].hours, got["three"].max_glucose) == (3, 2)
    assert (got["all"].hours, got["all"].avg_glucose) == (10, 4.5)
