import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospan.operators import features


def test_rolling_matches_pandas(waves):
    got = features.add_rolling(waves).where("patient_id = 1").toPandas().sort_values("hour_ts")
    series = got["glucose"]
    for n in (6, 12, 24, 72):
        mean, std = series.rolling(n).mean(), series.rolling(n).std()
        np.testing.assert_allclose(got[f"glucose_rolling_mean_{n}h"], mean, rtol=1e-12)
        np.testing.assert_allclose(got[f"glucose_rolling_std_{n}h"], std, rtol=1e-9)


def test_windows_that_do_not_divide_each_other(waves):
    got = features.add_rolling(waves, (5, 7)).where("patient_id = 2").toPandas().sort_values("hour_ts")
    np.testing.assert_allclose(got["glucose_rolling_std_7h"], got["glucose"].rolling(7).std(), rtol=1e-9)


def test_rolling_needs_every_value(make_hourly):
    rows = make_hourly([(1, h, None if h == 20 else 100 + h) for h in range(60)])
    got = features.add_rolling(rows).orderBy("hour_ts").collect()
    known = [r.hour_ts.hour + 24 * (r.hour_ts.day - 1) for r in got if r.glucose_rolling_mean_6h is not None]
    assert known == list(range(5, 20)) + list(range(26, 60))
    twelve = [i for i, r in enumerate(got) if r.glucose_rolling_std_12h is not None]
    assert twelve == list(range(11, 20)) + list(range(32, 60))


def test_constant_window_has_no_deviation(make_hourly):
    got = features.add_rolling(make_hourly([(1, h, 100.1) for h in range(30)]))
    assert got.agg(F.max("glucose_rolling_std_24h")).first()[0] == pytest.approx(0, abs=1e-9)


def test_lag_plus_difference_is_the_target_unless_leak_free(waves):
    def residual(leak_free):
        table = features.build_features(waves, leak_free)
        gap = F.abs(F.col("glucose_lag_1h") + F.col("glucose_diff_1h") - F.col("glucose"))
        return table.agg(F.max(gap)).first()[0]

    assert residual(False) < 1e-9
    assert residual(True) > 1


def test_feature_table_shape(waves):
    table = features.build_features(waves)
    assert len(table.columns) == 2 + 25
    assert len(features.input_columns(table)) == 20
    # 72 rows are needed before the first complete one
    assert table.count() == 2 * (960 - 71)


def test_hours_with_one_reading_are_dropped(make_hourly):
    rows = make_hourly([(1, h, 100 + h % 5) for h in range(100)]).withColumn(
        "glucose_std", F.when(F.hour("hour_ts") != 5, F.col("glucose_std"))
    )
    assert features.build_features(rows).where("hour = 5").count() == 0


def test_windows_share_one_shuffle(make_hourly):
    rows = make_hourly([(1, h, 100) for h in range(3)])
    plan = features.build_features(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_calendar(make_hourly):
    row = features.add_calendar(make_hourly([(1, 5 * 24 + 7, 100)]), True).first()
    assert (row.hour, row.day_of_week, row.day_of_month, row.month, row.is_weekend) == (7, 5, 6, 1, 1)


def test_expanding_rolling_starts_at_once(make_hourly):
    got = features.add_expanding_rolling(make_hourly([(1, 0, 100), (1, 1, 110)])).orderBy("hour_ts").collect()
    assert got[0].glucose_rolling_mean == 100 and got[0].glucose_rolling_std is None
    assert got[1].glucose_rolling_mean == 105


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (1, 5.0, 3.0)], "patient_id long, a double, b double")
    got = features.standard_scale(df, ["a", "b"]).orderBy("b").collect()
    assert [(r.a, r.b) for r in got] == [(0.0, -1.0), (0.0, 1.0)]
