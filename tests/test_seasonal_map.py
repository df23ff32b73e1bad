import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospan.operators import forecasting, models, seasonal_map
from glycospan.operators.seasonal import _fourier, _hinges


def test_exact_lasso_meets_its_conditions():
    rng = np.random.default_rng(1)
    knots = np.linspace(0, 0.8, 27)[1:-1]
    at = np.sort(rng.random(400))
    design = _hinges(at, knots)
    for scale in (0.3, 3.0, 30.0):
        y = np.where(at < 0.4, at, 0.8 - at) + rng.normal(0, 0.05, 400)
        gram, moment = design.T @ design / 0.05**2 + 1e-8 * np.eye(27), design.T @ y / 0.05**2
        weight = np.r_[0.0, 0.0, np.full(25, scale * 20)]
        w = seasonal_map.lasso_exactly(gram, moment, weight, np.zeros(27))
        slope, slack = gram @ w - moment, 1e-6 * np.abs(moment).max()
        on = w != 0
        assert np.abs(slope + weight * np.sign(w))[on].max() <= slack
        assert (np.abs(slope)[~on] <= weight[~on] + slack).all()
    assert on[2:].sum() < 12  # most changes vanish


def direct(cost, start, rounds=4000, seed=0):
    """A direct search: random steps along random directions, kept when they lower the cost."""
    rng = np.random.default_rng(seed)
    best, value, step = start.copy(), cost(start), 0.1
    for _ in range(rounds):
        move = rng.normal(0, step, len(best)) * (rng.random(len(best)) < 0.3)
        for other in (best + move, best - move):
            if (v := cost(other)) < value:
                best, value = other, v
                step = min(step * 1.3, 0.3)
                break
        else:
            step = max(step * 0.97, 1e-5)
    return value


def test_the_mode_is_not_beaten_by_a_direct_search():
    rng = np.random.default_rng(2)
    hours = np.arange(24 * 14, dtype=float)
    at = hours / hours[-1]
    y = (0.6 + 0.2 * np.maximum(at - 0.5, 0)) * (1 + 0.2 * np.sin(2 * np.pi * hours / 24)) + rng.normal(0, 0.02, len(hours))
    design, waves = _hinges(at, np.linspace(0, 0.8, 27)[1:-1]), _fourier(hours)
    fit = seasonal_map.fit_mode(y, design, waves)
    assert fit.converged

    def cost(v):
        return seasonal_map.objective(y, design, waves, v[:27], v[27:-1], np.exp(v[-1]))

    here = np.r_[fit.trend, fit.season, np.log(fit.variance)]
    assert cost(here) == pytest.approx(fit.objective)
    assert direct(cost, here) >= fit.objective - 1e-4
    far = here * 0
    far[0], far[-1] = y.mean(), np.log(y.var())
    assert direct(cost, far) >= fit.objective - 1e-4
    near = here + rng.normal(0, 0.01, len(here))
    assert direct(cost, near, seed=3) >= fit.objective - 1e-4
    assert (np.abs(fit.trend[2:]) > 1e-9).sum() < 25
    np.testing.assert_allclose(np.sqrt(fit.variance), 0.02, rtol=0.15)


def test_constant_and_single_values(make_hourly):
    rows = [(1, h, 100.0) for h in range(60)] + [(2, 0, 90.0)] + [(3, 0, None)]
    model = seasonal_map.fit_map_trend(make_hourly(rows))
    got = {r.patient_id: r for r in model.coefficients.collect()}
    assert set(got) == {1, 2}
    scored = model.predict(make_hourly(rows), "hour_ts").groupBy("patient_id").agg(F.min("predicted_glucose").alias("v")).collect()
    assert {r.patient_id: r.v and round(r.v, 1) for r in scored} == {1: 100.0, 2: 90.0, 3: None}


def test_bounds_widen_and_follow_the_changes(spark, waves):
    grid = forecasting.future_grid(waves, 120).withColumn("trend", F.lit(100.0)).withColumn("season", F.lit(1.0))
    still = spark.createDataFrame([(1, 0.02, 0.0, 5.0), (2, 0.02, 1.0, 5.0)], "patient_id long, change_chance double, change_size double, sigma double")
    rows = seasonal_map.drawn_bounds(grid, still, 400, 3).orderBy("patient_id", "step").collect()
    width = np.array([r.upper_bound - r.lower_bound for r in rows]).reshape(2, 120)
    assert width[0].mean() == pytest.approx(2 * 1.96 * 5, rel=0.05)
    assert abs(width[0, 100:].mean() / width[0, :20].mean() - 1) < 0.1
    assert width[1, 100:].mean() > 3 * width[1, :20].mean()
    again = seasonal_map.drawn_bounds(grid.repartition(7), still, 400, 3).orderBy("patient_id", "step").collect()
    assert [r.upper_bound for r in again] == [r.upper_bound for r in rows]


def test_forecasts_of_the_mode_have_drawn_bounds(waves):
    history = waves.where("hour_ts < timestamp '2024-01-25'")
    model = models.fit_model("prophet", history, method="map").model
    table = forecasting.seasonal_forecast(model, history, forecasting.future_grid(history, 48))
    future = table.where("is_future")
    assert table.count() == history.count() + 96
    assert future.where("lower_bound < predicted_glucose and predicted_glucose < upper_bound").count() == 96
    error = history.join(table.withColumnRenamed("timestamp", "hour_ts"), ["patient_id", "hour_ts"]).select(F.avg(F.abs(history.glucose - F.col("predicted_glucose")))).first()[0]
    assert error < 10


def test_drawn_bounds_make_no_row_for_a_draw_and_spread_patients(spark):
    rows = spark.sql(
        """SELECT p AS patient_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, h) AS timestamp, 100D AS trend, 1D AS season
        FROM (SELECT explode(sequence(1L, 30L)) AS p) CROSS JOIN (SELECT explode(sequence(1, 3)) AS h)"""
    )
    changes = spark.range(1, 31).selectExpr("id AS patient_id", "0.1D AS change_chance", "1D AS change_size", "2D AS sigma")
    bounds = seasonal_map.drawn_bounds(rows, changes, 20)
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert "draw" not in plan and "REPARTITION_BY_NUM" in plan
    assert bounds.where("lower_bound < upper_bound").count() == 90
