import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospan.operators import features, gram, models
from glycospan.operators.neighbours import predict_neighbours


@pytest.fixture(scope="module")
def table(waves):
    return features.build_features(waves, leak_free=True).persist()


@pytest.fixture(scope="module")
def arrays(table):
    pdf = table.where("patient_id = 1").toPandas().sort_values("hour_ts")
    x = pdf[features.input_columns(table)].to_numpy(float)
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread == 0, 1, spread)
    return z, pdf["glucose"].to_numpy(float), pdf


def predicted(model, rows):
    return model.predict(rows).toPandas().sort_values("hour_ts")["prediction"].to_numpy()


@pytest.mark.parametrize("scope", ["pooled", "patient"])
def test_ridge_is_the_closed_form(table, arrays, scope):
    z, y, _ = arrays
    rows = table.where("patient_id = 1")
    model = models.fit_model("ridge", rows, scope, alpha=10.0)
    w = np.linalg.solve(z.T @ z + 10.0 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    np.testing.assert_allclose(predicted(model, rows), z @ w + y.mean(), atol=1e-6)


@pytest.mark.parametrize("scope", ["pooled", "patient"])
def test_least_squares(table, arrays, scope):
    z, y, _ = arrays
    rows = table.where("patient_id = 1")
    w = np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
    got = predicted(models.fit_model("linear_regression", rows, scope), rows)
    np.testing.assert_allclose(got, z @ w + y.mean(), atol=1e-3)


@pytest.mark.parametrize("scope", ["pooled", "patient"])
def test_lasso_meets_its_optimality_conditions(table, arrays, scope):
    z, y, _ = arrays
    rows = table.where("patient_id = 1")
    got = predicted(models.fit_model("lasso", rows, scope, alpha=1.0), rows)
    pull = z.T @ (y - got) / len(y)  # |gradient| <= alpha, up to the solver's tolerance
    assert np.abs(pull).max() <= 1.0 + 1e-2
    assert np.abs(pull).max() >= 1.0 - 1e-2


def test_patient_models_do_not_mix_patients(table):
    both = models.fit_model("ridge", table, "patient")
    alone = models.fit_model("ridge", table.where("patient_id = 2"), "patient")
    rows = table.where("patient_id = 2")
    np.testing.assert_allclose(predicted(both, rows), predicted(alone, rows))


def test_pooled_models_learn_every_patient(table):
    for name, params in (
        ("decision_tree", {}),
        ("random_forest", {"trees": 5, "depth": 6}),
        ("gradient_boosting", {"iterations": 5, "depth": 3}),
        ("svr", {"waves": 64}),
    ):
        scores = models.training_r2(models.fit_model(name, table, **params), table).collect()
        assert len(scores) == 2
        assert all(0.5 < r.r2 <= 1 for r in scores), (name, scores)


def test_importances(table):
    model = models.fit_model("decision_tree", table)
    top = model.importances().collect()
    assert len(top) == 5
    assert [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)
    assert model.importances(None).agg(F.sum("importance")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        models.fit_model("ridge", table).importances()


def test_neighbours_match_brute_force(table, arrays):
    z, y, pdf = arrays
    rows = table.where("patient_id = 1").orderBy("hour_ts")
    model = models.fit_model("knn", rows)
    some = rows.where("hour < 4")
    got = model.predict(some).toPandas().sort_values("hour_ts")["prediction"].to_numpy()
    picked = pdf["hour"].to_numpy() < 4
    want = []
    for q in z[picked]:
        near = np.argsort(((z - q) ** 2).sum(axis=1), kind="stable")[:5]
        want.append(y[near].mean())
    np.testing.assert_allclose(got, want)


def test_neighbours_across_blocks(spark, monkeypatch, make_hourly):
    from glycospan.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rows = make_hourly([(1, h, h * 1.0) for h in range(40)]).withColumn("x", F.col("glucose"))
    got = predict_neighbours(rows, rows, ["x"], k=1).join(rows, ["patient_id", "hour_ts"])
    assert got.count() == 40
    assert got.where("prediction <> glucose").count() == 0


def test_unknown_names_are_refused(table):
    with pytest.raises(ValueError):
        models.fit_model("oracle", table)
    with pytest.raises(ValueError):
        models.fit_model("oracle", table, "patient")
    assert set(models.ALGORITHMS) == set(models.DEFAULT_PARAMS)


def test_a_forest_does_not_depend_on_how_its_rows_are_laid_out(table):
    rows = table.where("patient_id = 1").limit(300).cache()
    found = []
    for parts in (1, 4, 16):
        model = models.fit_model("random_forest", rows.repartition(parts), trees=4, depth=4)
        found.append([round(r.prediction, 9) for r in model.predict(rows).orderBy("hour_ts").collect()])
    assert found[0] == found[1] == found[2]


def test_rows_of_a_patient_without_training_rows_are_kept(table):
    train = table.where("patient_id = 1")
    for name, scope in (("ridge", "pooled"), ("ridge", "patient"), ("knn", "pooled"), ("prophet", "pooled")):
        scored = models.fit_model(name, train, scope).predict(table)
        rows = {r.patient_id: r for r in scored.groupBy("patient_id").agg(F.count("*").alias("n"), F.count("prediction").alias("known")).collect()}
        assert rows[1].n == rows[1].known and rows[2].n > 0 and rows[2].known == 0


def test_dependent_inputs_have_the_least_norm_solution(make_hourly):
    rows = make_hourly([(1, h, 100.0 + 3 * h) for h in range(20)]).withColumn("a", F.hour("hour_ts").cast("double"))
    rows = rows.withColumns({"b": F.col("a"), "still": F.lit(4.0)})
    for name, scope in (("linear_regression", "patient"), ("ridge", "patient"), ("linear_regression", "pooled")):
        model = models.fit_model(name, rows, scope, **({"alpha": 0.0} if name == "ridge" else {}))
        np.testing.assert_allclose(predicted(model, rows), [100.0 + 3 * h for h in range(20)], atol=1e-6)
    (row,) = models.fit_model("ridge", rows, "patient", alpha=0.0).coefficients.collect()
    np.testing.assert_allclose(row.coef, [1.5, 1.5, 0.0], atol=1e-6)
    assert row.converged and row.n == 20


def test_statistics_of_parts_add_up_to_those_of_the_whole(table):
    columns = features.input_columns(table)
    early, late = table.where("hour_ts < '2024-01-20'"), table.where("hour_ts >= '2024-01-20'")
    by_day = gram.statistics(late.withColumn("day", F.to_date("hour_ts")), columns, ("patient_id", "day"))
    size = len(columns)
    parts = gram.merged(gram.statistics(early, columns), gram.merged(by_day, size=size), size=size)
    want = models.fit_model("ridge", table, "patient")
    got = models.from_statistics("ridge", parts, columns)
    rows = table.where("patient_id = 2")
    np.testing.assert_allclose(predicted(got, rows), predicted(want, rows), atol=1e-6)


def test_linear_fits_send_no_rows_to_python(table):
    """Only the statistics, one row for each patient, reach the solver."""
    plan = models.fit_model("ridge", table, "patient").coefficients._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("HashAggregate", 1) if "HashAggregate" in plan else plan.split("ObjectHashAggregate", 1)
    assert "MapInPandas" in above and "Pandas" not in below


def test_near_ties_are_settled_by_exact_distances():
    from glycospan.operators.neighbours import _nearest_means

    rng = np.random.default_rng(9)
    known = rng.integers(-2, 3, (400, 4)) + 1e4  # many equal distances, far from the origin
    queries, y = known[:50] + rng.integers(0, 2, (50, 4)), rng.normal(0, 1, 400)
    distance = ((queries[:, None, :] - known[None, :, :]) ** 2).sum(axis=2)
    for k in (1, 5, 400, 999):
        want = [y[np.argsort(d, kind="stable")[:k]].mean() for d in distance]
        np.testing.assert_allclose(_nearest_means(queries, known, y, k), want, atol=1e-12)


def test_the_same_neighbours_have_the_same_mean_in_any_order():
    from glycospan.operators.neighbours import _nearest_means

    known, y = np.array([[0.0], [1.0], [2.0]]), np.array([0.1, 0.2, 0.3])
    left, right = _nearest_means(np.array([[-1.0], [3.0]]), known, y, 5)
    assert left == right


def test_neighbours_of_many_patients_in_few_tasks(spark, monkeypatch):
    from glycospan.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 3)
    monkeypatch.setattr(neighbours, "ROWS_TOGETHER", 100)
    rng = np.random.default_rng(2)
    data = [(p, i, float(rng.normal()), float(rng.normal())) for p in range(40) for i in range(12)]
    rows = spark.createDataFrame(data, "patient_id long, i int, x double, glucose double")
    rows = rows.withColumn("hour_ts", F.timestamp_seconds(F.col("i") * 3600))
    train, asked = rows.where("i < 5 and patient_id > 0"), rows.where("i >= 5")
    got = neighbours.predict_neighbours(train, asked, ["x"], k=3).collect()
    assert len(got) == 40 * 7
    for r in got:
        mine = [d for d in data if d[0] == r.patient_id and d[1] < 5]
        i = int(r.hour_ts.timestamp()) // 3600
        x = next(d[2] for d in data if d[0] == r.patient_id and d[1] == i)
        near = sorted(mine, key=lambda d: abs(d[2] - x))[:3]
        wanted = None if r.patient_id == 0 else pytest.approx(sum(d[3] for d in near) / 3)
        assert r.prediction == wanted
