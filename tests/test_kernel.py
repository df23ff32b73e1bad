import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospan.operators import features, forecasting, kernel, models


def gram(x, gamma):
    return np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def check_optimal(x, y, gamma, c, epsilon, fit, tolerance):
    """The conditions of the dual: where a weight lies says on which side of the band its row is."""
    f = gram(x, gamma) @ fit.beta + fit.intercept
    error = y - f
    slack = tolerance + 1e-9
    assert abs(fit.beta.sum()) < 1e-9 and (np.abs(fit.beta) <= c + 1e-12).all()
    inside = fit.beta == 0
    assert (np.abs(error[inside]) <= epsilon + slack).all()
    for sign in (1, -1):
        free = (sign * fit.beta > 0) & (np.abs(fit.beta) < c)
        np.testing.assert_allclose(sign * error[free], epsilon, atol=slack)
        assert (sign * error[fit.beta == sign * c] >= epsilon - slack).all()


@pytest.mark.parametrize("c, epsilon", [(1.0, 0.1), (50.0, 0.5), (0.01, 0.0)])
def test_solutions_meet_the_dual_conditions(c, epsilon):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (120, 4))
    x[40:50] = x[:10]  # rows of the same place with other targets
    y = 10 * np.sin(x[:, 0]) + x[:, 1] + rng.normal(0, 0.5, 120)
    fit = kernel.solve(x, y, 0.25, c, epsilon, 1e-6)
    assert fit.gap <= 1e-6
    check_optimal(x, y, 0.25, c, epsilon, fit, 1e-6)


def test_no_feasible_move_lowers_the_objective():
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (40, 3)), rng.normal(0, 5, 40)
    fit = kernel.solve(x, y, 0.3, 1.0, 0.1, 1e-8)
    k = gram(x, 0.3)
    value = lambda b: b @ k @ b / 2 - y @ b + 0.1 * np.abs(b).sum()
    best = value(fit.beta)
    for _ in range(500):
        other = fit.beta + rng.normal(0, 0.1, 40) * (rng.random(40) < 0.2)
        other = np.clip(other - other.mean(), -1, 1)
        if abs(other.sum()) < 1e-9:
            assert value(other) >= best - 1e-9


def test_a_small_cache_gives_the_same_solution(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, (60, 3)), rng.normal(0, 5, 60)
    whole = kernel.solve(x, y, 0.3, 1.0, 0.1)
    monkeypatch.setattr(kernel.KernelRows.__init__, "__defaults__", (0,))
    np.testing.assert_array_equal(kernel.solve(x, y, 0.3, 1.0, 0.1).beta, whole.beta)


def test_edge_cases():
    assert kernel.solve(np.zeros((0, 2)), np.zeros(0), 1.0, 1.0, 0.1).steps == 0
    one = kernel.solve(np.ones((1, 2)), np.array([5.0]), 1.0, 1.0, 0.1)
    assert one.beta.tolist() == [0.0] and one.intercept == pytest.approx(5.0)
    same = kernel.solve(np.ones((6, 2)), np.array([1.0, 1, 1, 9, 9, 9]), 1.0, 1.0, 0.1)
    assert same.gap <= 8 and 1 <= same.intercept <= 9


@pytest.fixture(scope="module")
def table(waves):
    return features.build_features(waves, leak_free=True).where("hour_ts < timestamp '2024-01-18'").persist()


def test_patients_fits_are_optimal_and_predict(table):
    model = models.fit_model("svr", table, "patient")
    fits = {r.patient_id: r for r in model.fits.collect()}
    assert set(fits) == {1, 2} and all(r.gap <= kernel.TOLERANCE and r.failure is None for r in fits.values())
    pdf = table.where("patient_id = 1").toPandas().sort_values("hour_ts")
    x, y = pdf[model.columns].to_numpy(float), pdf["glucose"].to_numpy(float)
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread == 0, 1, spread)
    gamma = 1 / (z.shape[1] * z.var())
    fit = kernel.solve(z, y, gamma, 1.0, 0.1)
    check_optimal(z, y, gamma, 1.0, 0.1, fit, kernel.TOLERANCE)
    got = model.predict(table.where("patient_id = 1")).orderBy("hour_ts").toPandas()["prediction"]
    np.testing.assert_allclose(got, gram(z, gamma) @ fit.beta + fit.intercept, atol=1e-6)


def test_the_exact_fit_has_a_recursive_forecast(waves, table):
    history = waves.where("hour_ts < timestamp '2024-01-18'")
    model = models.fit_model("svr", table, "patient")
    steps = forecasting.forecast_recursive(model, history, forecasting.future_grid(history, 30))
    assert steps.where(F.col("predicted_glucose").between(40, 400)).count() == 60
    first = steps.where("step = 1").select("patient_id", F.col("timestamp").alias("hour_ts"), "predicted_glucose")
    ahead = first.select("patient_id", "hour_ts", F.lit(0.0).alias("glucose"))
    row = features.build_features(history.select("patient_id", "hour_ts", "glucose").unionByName(ahead), True, False).join(first, ["patient_id", "hour_ts"])
    for r in model.predict(row).collect():
        assert r.prediction == pytest.approx(r.predicted_glucose, abs=1e-6)
