import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glycospan.operators import features, forecasting, models, seasonal
from tests.conftest import START


@pytest.mark.parametrize("freq,alias", [("H", "h"), ("D", "D"), ("W", "W")])
@pytest.mark.parametrize("hours", [5, 6 * 24 + 22, 6 * 24 + 23, 7 * 24 + 3])
def test_grid_matches_date_range(make_hourly, freq, alias, hours):
    grid = forecasting.future_grid(make_hourly([(1, hours, 100)]), 6, freq)
    got = [r.timestamp for r in grid.orderBy("step").collect()]
    start = pd.Timestamp(START) + pd.Timedelta(hours=hours + 1)
    assert got == list(pd.date_range(start, periods=6, freq=alias))


def test_whole_steps_start_one_step_later(make_hourly):
    grid = forecasting.future_grid(make_hourly([(1, 5, 100)]), 2, "D", whole_step=True)
    assert [r.timestamp for r in grid.orderBy("step").collect()] == [
        START + dt.timedelta(days=1, hours=5),
        START + dt.timedelta(days=2, hours=5),
    ]


def test_far_range_is_whole_unless_parity(make_hourly):
    history = make_hourly([(1, 0, 100)])
    start, end = "2024-04-10 00:00:00", "2024-04-11 00:00:00"
    assert forecasting.range_grid(history, start, end).count() == 25
    assert forecasting.range_grid(history, start, end, parity=True).count() == 0


def test_range_inside_the_history_has_no_future_rows(make_hourly):
    history = make_hourly([(1, 100, 100)])
    assert forecasting.range_grid(history, "2024-01-01", "2024-01-03").count() == 0


def test_named_horizons():
    assert forecasting.horizon("Next Week") == 168
    with pytest.raises(ValueError):
        forecasting.horizon("Next Century")


def test_seasonal_trend_recovers_a_product(make_hourly):
    def value(h):
        return (100 + 0.05 * h) * (1 + 0.2 * np.sin(2 * np.pi * h / 24))

    history = make_hourly([(1, h, value(h)) for h in range(28 * 24)])
    grid = forecasting.future_grid(history, 48)
    for fit in (seasonal.fit_seasonal_trend, seasonal.fit_fourier_trend):
        got = fit(history).predict(grid).orderBy("step").collect()
        want = [value(28 * 24 + i) for i in range(48)]
        assert np.abs(np.array([r.predicted_glucose for r in got]) - want).max() < 4
        assert all(r.lower_bound <= r.predicted_glucose <= r.upper_bound for r in got)


def test_unseen_hour_of_week_takes_its_hour_of_day(make_hourly):
    history = make_hourly([(1, h, 100 + h % 24) for h in range(48)])
    grid = forecasting.future_grid(history, 72)
    got = seasonal.fit_seasonal_trend(history).predict(grid)
    assert got.where("predicted_glucose is null").count() == 0
    assert got.count() == 72


def test_noise_does_not_depend_on_partitions(waves):
    grid = forecasting.future_grid(waves, 72)
    future = grid.withColumns({"predicted_glucose": F.lit(100.0), "trend": F.lit(100.0)})
    results = [
        sorted(forecasting.add_noise(future.repartition(n), waves, seed=4).collect()) for n in (1, 7, 64)
    ]
    assert results[0] == results[1] == results[2]
    other = sorted(forecasting.add_noise(future, waves, seed=5).collect())
    assert other != results[0]


def test_noise_has_the_wanted_spread(waves):
    grid = forecasting.future_grid(waves, 5000)
    future = grid.withColumns({"predicted_glucose": F.lit(0.0), "trend": F.lit(0.0)})
    got = forecasting.add_noise(future, waves, 0.2).where("patient_id = 1")
    mean, std = got.agg(F.avg("predicted_glucose"), F.stddev("predicted_glucose")).first()
    pdf = waves.where("patient_id = 1").toPandas()
    whole = pdf["glucose"].std()
    hourly = pdf.groupby(pdf["hour_ts"].dt.hour)["glucose"].std()
    want = 0.2 * np.sqrt(whole**2 + 0.25 * np.mean(hourly**2))
    assert mean == pytest.approx(0, abs=0.3) and std == pytest.approx(want, rel=0.05)


def test_bounds_and_clip(waves):
    grid = forecasting.future_grid(waves, 3)
    future = grid.withColumns({"predicted_glucose": F.lit(395.0), "trend": F.lit(410.0)})
    spread = {r.patient_id: r.hist_std for r in forecasting.history_spread(waves).collect()}
    bounded = forecasting.add_bounds(future, waves)
    for r in bounded.collect():
        assert r.upper_bound - 395 == pytest.approx(0.4 * spread[r.patient_id])
    table = forecasting.clip_forecast(forecasting.with_history(bounded, waves))
    assert table.count() == 2 * 960 + 6
    ahead = forecasting.future_only(table).first()
    assert ahead.upper_bound == 400 and ahead.trend == 410
    wide = forecasting.add_bounds(
        future, waves, "residual", residuals=waves.select("patient_id").distinct().withColumn("residual_std", F.lit(10.0))
    ).first()
    assert wide.predicted_glucose - wide.lower_bound == pytest.approx(19.6)


@pytest.fixture(scope="module")
def table(waves):
    return features.build_features(waves, leak_free=True).persist()


@pytest.mark.parametrize("mode", ["frozen", "zero_fill", "recursive"])
def test_regressor_forecast(waves, table, mode):
    model = models.fit_model("ridge", table, "patient")
    grid = forecasting.future_grid(table, 48)
    got = forecasting.regressor_forecast(model, table, grid, mode)
    ahead = forecasting.future_only(got)
    assert ahead.count() == 2 * 48
    assert ahead.where("predicted_glucose is null").count() == 0
    assert got.where("not is_future").count() == table.count()


def test_recursion_matches_rebuilding_the_features(waves, table):
    """Append each prediction to the history and build its features again."""
    model = models.fit_model("linear_regression", table, "patient")
    coef = {r.patient_id: r for r in model.coefficients.collect()}[1]
    one = table.where("patient_id = 1")
    got = forecasting.forecast_recursive(model, one, forecasting.future_grid(one, 5))
    got = [r.predicted_glucose for r in got.orderBy("step").collect()]

    series = one.toPandas().sort_values("hour_ts").set_index("hour_ts")["glucose"]
    want = []
    for _ in range(5):
        at = series.index[-1] + pd.Timedelta(hours=1)
        s = pd.concat([series, pd.Series([np.nan], index=[at])])
        row = {"hour": at.hour, "day_of_week": at.dayofweek, "day_of_month": at.day, "month": at.month}
        for k in (1, 2, 3, 6, 12, 24):
            row[f"glucose_lag_{k}h"] = s.shift(k).iloc[-1]
        for n in (6, 12, 24, 72):
            row[f"glucose_rolling_mean_{n}h"] = s.rolling(n).mean().shift(1).iloc[-1]
            row[f"glucose_rolling_std_{n}h"] = s.rolling(n).std().shift(1).iloc[-1]
        for k in (1, 3):
            row[f"glucose_diff_{k}h"] = s.diff(k).shift(1).iloc[-1]
        y = float(np.dot([row[c] for c in model.columns], coef.coef) + coef.intercept)
        want.append(y)
        series = pd.concat([series, pd.Series([y], index=[at])])
    np.testing.assert_allclose(got, want, rtol=1e-8)


def test_recursion_counts_hours_and_not_kept_rows(make_hourly):
    """With hours missing shortly before the end, a lag is still so many hours back."""
    hours = [(1, h, 100.0 + h % 50) for h in range(200)]
    grid = make_hourly([(p, h, None if h in (196, 197) else v) for p, h, v in hours])
    table = features.add_lags(grid, (3,)).select("patient_id", "hour_ts", "glucose", "glucose_lag_3h")
    model = models.fit_model("linear_regression", table.na.drop("any"), "patient")
    line = model.coefficients.first()
    got = forecasting.forecast_recursive(model, grid, forecasting.future_grid(grid, 3)).orderBy("step").collect()
    known = {h: v for _, h, v in hours}
    between = known[195] + (known[198] - known[195]) * 2 / 3  # hour 197, on the line between its neighbours
    want = [line.coef[0] * v + line.intercept for v in (between, known[198], known[199])]
    np.testing.assert_allclose([r.predicted_glucose for r in got], want, rtol=1e-9)


@pytest.mark.parametrize("name", ["ridge", "svr"])
def test_recursion_of_pooled_models_starts_like_their_predictions(waves, table, name):
    """The first step of a patient is the model's own prediction of the row after the last."""
    model = models.fit_model(name, table, "pooled", **({"waves": 16} if name == "svr" else {}))
    last = table.groupBy("patient_id").agg(F.max("hour_ts").alias("t"))
    cut = waves.join(last, "patient_id").where("hour_ts < t").drop("t")
    got = forecasting.forecast_recursive(model, cut, forecasting.future_grid(cut, 1)).orderBy("patient_id").collect()
    want = model.predict(table.join(last, "patient_id").where("hour_ts = t").drop("t")).orderBy("patient_id").collect()
    np.testing.assert_allclose([r.predicted_glucose for r in got], [r.prediction for r in want], rtol=1e-6)


def test_models_of_stored_rows_have_no_recursive_forecast(table):
    model = models.fit_model("knn", table)
    with pytest.raises(ValueError, match="no recursive forecast"):
        forecasting.forecast_recursive(model, table, forecasting.future_grid(table, 2))


def test_live_recursion_of_the_small_feature_set(waves):
    simple = features.simple_features(waves).na.drop("any")
    model = models.fit_model("ridge", simple, "patient")
    got = forecasting.forecast_recursive(model, simple, forecasting.future_grid(simple, 30))
    assert got.where("predicted_glucose between 40 and 400").count() == 60


def test_noise_is_fed_back(waves):
    """A lag-1 model keeps part of the noise of the steps before."""
    simple = features.add_lags(waves, (1,)).select("patient_id", "hour_ts", "glucose", "glucose_lag_1h")
    simple = simple.na.drop("any")
    model = models.fit_model("linear_regression", simple, "patient")
    coef = {r.patient_id: r for r in model.coefficients.collect()}[1]
    grid = forecasting.future_grid(simple, 4)
    noisy = forecasting.forecast_recursive(model, simple, grid, 0.2, 9).where("patient_id = 1")
    draws = forecasting.with_noise_column(grid, simple, 0.2, 9).where("patient_id = 1")
    draws = [r.noise for r in draws.orderBy("step").collect()]
    last = simple.where("patient_id = 1").orderBy(F.desc("hour_ts")).first().glucose
    want = []
    for draw in draws:
        last = coef.coef[0] * last + coef.intercept + draw
        want.append(last)
    got = [r.predicted_glucose for r in noisy.orderBy("step").collect()]
    np.testing.assert_allclose(got, want)


def test_status(spark):
    summary = spark.createDataFrame(
        [(1, 100.0, 60.0, 170.0), (2, 65.0, 60.0, 90.0), (3, 200.0, 80.0, 260.0)],
        "patient_id long, mean_predicted double, min_predicted double, max_predicted double",
    )
    got = [
        (r.status, r.low_risk, r.high_risk)
        for r in forecasting.forecast_status(summary).orderBy("patient_id").collect()
    ]
    assert got == [
        ("Healthy", "Low Risk", "Safe"),
        ("Low", "Low Risk", "Safe"),
        ("High", "Safe", "High Risk"),
    ]
