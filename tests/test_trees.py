import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospan.operators import boosting, features, forecasting, models, trees


def brute_tree(x, y, depth, min_split, min_leaf, penalty=0.0, least_gain=0.0):
    """A nested (input, threshold, low, high) or a leaf's value, by trying every split of every node."""
    value = y.sum() / (len(y) + penalty)
    if depth == 0 or len(y) < min_split:
        return value
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values[:-1], values[1:]):
            low = x[:, f] <= (a + b) / 2
            nl, nr = low.sum(), (~low).sum()
            if min(nl, nr) < min_leaf:
                continue
            gain = y[low].sum() ** 2 / (nl + penalty) + y[~low].sum() ** 2 / (nr + penalty) - y.sum() ** 2 / (len(y) + penalty)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, (a + b) / 2, low)
    if best is None or best[0] <= max(2 * least_gain, 1e-9):
        return value
    _, f, cut, low = best
    args = (depth - 1, min_split, min_leaf, penalty, least_gain)
    return f, cut, brute_tree(x[low], y[low], *args), brute_tree(x[~low], y[~low], *args)


def follow(tree, row):
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def data(rng, n, coarse=True):
    x = np.column_stack([rng.integers(0, 6, n), rng.normal(0, 1, n).round(1 if coarse else 6), rng.integers(0, 2, n)]).astype(float)
    return x, x[:, 0] * 3 + np.sin(3 * x[:, 1]) * 5 + rng.normal(0, 1, n)


@pytest.mark.parametrize("settings", [(4, 2, 1, 0.0, 0.0), (6, 5, 2, 0.0, 0.0), (3, 2, 1, 1.0, 4.0)])
def test_trees_grown_together_are_the_trees_grown_alone(settings):
    rng = np.random.default_rng(1)
    depth, min_split, min_leaf, penalty, least_gain = settings
    limits = trees.Growth(depth, min_split, min_leaf, penalty, least_gain)
    sizes = [60, 1, 7, 120, 2]
    parts = [data(rng, n) for n in sizes]
    x, y = np.vstack([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    root = np.repeat(np.arange(len(sizes)), sizes)
    nodes, leaf = trees.grow(x, y, np.ones(len(y), np.int64), root, len(sizes), limits)
    want = np.concatenate([[follow(brute_tree(a, b, *settings), row) for row in a] for a, b in parts])
    np.testing.assert_allclose(nodes.value[leaf], want, atol=1e-8)
    at = trees.descend(nodes.feature, nodes.threshold, nodes.left, nodes.right, root[:, None], x, np.arange(len(x))[:, None])
    np.testing.assert_array_equal(at[:, 0], leaf)
    assert (nodes.root[leaf] == root).all()


def test_weights_count_like_repeated_rows():
    rng = np.random.default_rng(2)
    x, y = data(rng, 50)
    weight = rng.integers(1, 4, 50)
    limits = trees.Growth(3)
    nodes, leaf = trees.grow(x, y, weight, np.zeros(50, np.int64), 1, limits)
    again = np.repeat(np.arange(50), weight)
    twice, leaf_twice = trees.grow(x[again], y[again], np.ones(len(again), np.int64), np.zeros(len(again), np.int64), 1, limits)
    np.testing.assert_allclose(nodes.value[leaf][again], twice.value[leaf_twice], atol=1e-8)


def test_equal_rows_and_no_rows_are_leaves():
    nodes, leaf = trees.grow(np.ones((4, 2)), np.array([1.0, 2, 3, 6]), np.ones(4, np.int64), np.zeros(4, np.int64), 2, trees.Growth(5))
    assert nodes.feature.tolist() == [-1, -1] and nodes.value[leaf].tolist() == [3.0] * 4


@pytest.fixture(scope="module")
def table(waves):
    return features.build_features(waves, leak_free=True).where("hour_ts < timestamp '2024-01-20'").persist()


def arrays(table, patient):
    pdf = table.where(F.col("patient_id") == patient).toPandas().sort_values("hour_ts")
    return pdf[features.input_columns(table)].to_numpy(float), pdf["glucose"].to_numpy(float)


def scores(model, rows):
    return model.predict(rows).orderBy("patient_id", "hour_ts").toPandas()["prediction"].to_numpy()


def test_a_patients_tree_is_brute_force_on_all_inputs(table):
    model = models.fit_model("decision_tree", table, "patient", depth=4)
    for patient in (1, 2):
        x, y = arrays(table, patient)
        tree = brute_tree(x, y - y.mean(), 4, 5, 1)
        got = scores(model, table.where(F.col("patient_id") == patient))
        np.testing.assert_allclose(got, [follow(tree, row) + y.mean() for row in x], atol=1e-6)


@pytest.mark.parametrize("name, penalty", [("gradient_boosting", 0.0), ("xgboost", 1.0)])
def test_boosting_of_a_patient_is_brute_force(table, name, penalty):
    model = models.fit_model(name, table, "patient", iterations=3, depth=2)
    x, y = arrays(table, 2)
    fitted = np.full(len(y), y.mean())
    for _ in range(3):
        tree = brute_tree(x, y - fitted, 2, 2, 1, penalty)
        fitted = fitted + 0.1 * np.array([follow(tree, row) for row in x])
    np.testing.assert_allclose(scores(model, table.where("patient_id = 2")), fitted, atol=1e-6)


def test_a_forest_is_the_mean_of_trees_on_its_samples(table):
    model = models.fit_model("random_forest", table, "patient", trees=12, depth=3)
    assert model.trees.count() == 24
    x, y = arrays(table, 1)
    want = np.zeros(len(y))
    for k in range(12):
        drawn = np.random.default_rng([42, 1, k]).integers(0, len(y), len(y))
        rows, weight = np.unique(drawn, return_counts=True)
        nodes, _ = trees.grow(x[rows], (y - y.mean())[rows], weight, np.zeros(len(rows), np.int64), 1, trees.Growth(3, 5, 2))
        at = trees.descend(nodes.feature, nodes.threshold, nodes.left, nodes.right, np.zeros((len(x), 1), np.int64), x, np.arange(len(x))[:, None])
        want += nodes.value[at[:, 0]] / 12
    np.testing.assert_allclose(scores(model, table.where("patient_id = 1")), want + y.mean(), atol=1e-6)


def test_trees_do_not_depend_on_other_patients_or_the_layout(table):
    alone = models.fit_model("random_forest", table.where("patient_id = 2"), "patient", trees=3, depth=4)
    both = models.fit_model("random_forest", table.repartition(7), "patient", trees=3, depth=4)
    rows = table.where("patient_id = 2")
    np.testing.assert_array_equal(scores(alone, rows), scores(both, rows))


def test_unknown_patients_and_missing_inputs_get_null(table):
    model = models.fit_model("decision_tree", table.where("patient_id = 1"), "patient", depth=3)
    odd = table.withColumn("glucose_lag_1h", F.when(F.col("hour") != 3, F.col("glucose_lag_1h")))
    found = model.predict(odd).groupBy("patient_id", (F.col("hour") == 3).alias("gap")).agg(F.count("*").alias("n"), F.count("prediction").alias("known")).collect()
    assert {(r.patient_id, r.gap): r.known == r.n for r in found if r.patient_id == 1} == {(1, True): False, (1, False): True}
    assert all(r.known == 0 for r in found if r.patient_id == 2)
    assert set(model.predict(odd).columns) == {*table.columns, "prediction"}


def test_importances_of_a_patient_add_up_to_one(table):
    for name, params in (("decision_tree", {"depth": 4}), ("random_forest", {"trees": 5, "depth": 4}), ("xgboost", {"iterations": 3, "depth": 2})):
        model = models.fit_model(name, table, "patient", **params)
        total = model.importances(None).groupBy("patient_id").agg(F.sum("importance").alias("s")).collect()
        assert [round(r.s, 9) for r in total] == [1.0, 1.0]
        top = model.importances(2).orderBy("patient_id", "place").collect()
        assert [r.place for r in top] == [1, 2, 1, 2]


def test_pooled_second_order_boosting_is_brute_force(spark):
    rng = np.random.default_rng(4)
    x, y = data(rng, 400)
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, label double").repartition(3).persist()
    params = {"iterations": 3, "depth": 2, "rate": 0.3, "penalty": 1.0, "least_weight": 1.0}
    flat = boosting.fit_second_order(rows, 400, 3, params)
    fitted = np.full(len(y), y.mean())
    for _ in range(3):
        tree = brute_tree(x, y - fitted, 2, 2, 1, 1.0)
        fitted = fitted + 0.3 * np.array([follow(tree, row) for row in x])
    np.testing.assert_allclose(flat.values(x), fitted, atol=1e-6)


def test_pooled_second_order_boosting_keeps_margins_and_ends_early(spark):
    rows = spark.createDataFrame([([float(i % 3)], float(i % 3 == 1)) for i in range(60)], "x array<double>, label double")
    flat = boosting.fit_second_order(rows, 60, 1, {"iterations": 12, "depth": 3, "rate": 0.5, "penalty": 0.0})
    np.testing.assert_allclose(flat.values(np.array([[0.0], [1.0], [2.0]])), [0, 1, 0], atol=2e-3)
    same = boosting.fit_second_order(rows.withColumn("label", F.lit(2.0)), 60, 1, {"iterations": 2, "depth": 3, "rate": 0.5})
    assert (same.feature == -1).all() and same.values(np.zeros((1, 1)))[0] == pytest.approx(2.0)


def test_many_values_share_bins(spark):
    rng = np.random.default_rng(5)
    values = rng.exponential(1.0, 5000)
    rows = spark.createDataFrame([([float(v)], 0.0) for v in values], "x array<double>, label double")
    (cuts,) = boosting.cut_points(rows, 5000, 1)
    assert 200 <= len(cuts) < boosting.BINS
    sizes = np.bincount(np.searchsorted(cuts, values))
    assert sizes.max() <= 3 * 5000 / boosting.BINS


@pytest.mark.parametrize("name, scope", [("decision_tree", "patient"), ("random_forest", "pooled"), ("gradient_boosting", "pooled"), ("xgboost", "pooled"), ("xgboost", "patient")])
def test_recursive_steps_are_the_models_own_predictions(waves, table, name, scope):
    """Each step equals predict() on features of the grid with the earlier steps filled in."""
    params = {"random_forest": {"trees": 4, "depth": 4}, "decision_tree": {"depth": 5}}.get(name, {"iterations": 3, "depth": 2})
    history = waves.where("hour_ts < timestamp '2024-01-20'")
    model = models.fit_model(name, table, scope, **params)
    grid = forecasting.future_grid(history, 2)
    steps = forecasting.forecast_recursive(model, history, grid).orderBy("patient_id", "step").collect()
    known = history.select("patient_id", "hour_ts", "glucose")
    for k in (1, 2):
        ahead = grid.where(F.col("step") == k).select("patient_id", F.col("timestamp").alias("hour_ts"), F.lit(0.0).alias("glucose"))
        row = features.build_features(known.unionByName(ahead), True, False).join(ahead.select("patient_id", "hour_ts"), ["patient_id", "hour_ts"])
        made = model.predict(row).orderBy("patient_id").collect()
        mine = [r for r in steps if r.step == k]
        np.testing.assert_allclose([r.predicted_glucose for r in mine], [r.prediction for r in made], atol=1e-6)
        filled = model.predict(row).select("patient_id", "hour_ts", F.col("prediction").alias("glucose"))
        known = spark_table(known.unionByName(filled))


def spark_table(df):
    """The rows as a new table: plans stay short from step to step."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_splits_that_tie_to_six_digits_go_to_the_first_input():
    x = np.array([[0, 0], [1, 0], [0, 1], [1, 1]], float)
    y = np.array([0.0, 1.0, 1.0 + 1e-9, 2.0])  # the second input is better by 2e-9
    nodes, _ = trees.grow(x, y - y.mean(), np.ones(4, np.int64), np.zeros(4, np.int64), 1, trees.Growth(1))
    assert nodes.feature[0] == 0


def test_a_threshold_is_half_way_between_neighbours_in_their_last_digit():
    low = 60.151999999999994
    high = np.nextafter(low, 99)
    for a, b in ((low, high), (high, np.nextafter(high, 99))):
        x, y = np.array([a, a, b, 70.0])[:, None], np.array([0.0, 0.0, 9.0, 9.0])
        nodes, leaf = trees.grow(x, y - y.mean(), np.ones(4, np.int64), np.zeros(4, np.int64), 1, trees.Growth(1))
        assert nodes.threshold[0] == (a + b) / 2
        np.testing.assert_array_equal(leaf == nodes.left[0], x[:, 0] <= (a + b) / 2)
        # both sides keep a row
        nodes, leaf = trees.grow(x[:3], y[:3] - y[:3].mean(), np.ones(3, np.int64), np.zeros(3, np.int64), 1, trees.Growth(1))
        assert set(leaf) == {nodes.left[0], nodes.right[0]}


def test_histograms_of_pooled_boosting_are_exact_sums(spark, monkeypatch):
    """Few or many tasks, and a child whose sums are those of its parent less its sibling's."""
    rng = np.random.default_rng(6)
    x, y = data(rng, 300)
    y = y * 1e6
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, label double").repartition(3).persist()
    params = {"iterations": 7, "depth": 3, "rate": 0.3, "penalty": 1.0, "least_weight": 1.0}
    one = boosting.fit_second_order(rows, 300, 3, params)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(boosting, "FEW_TASKS", 1)
    monkeypatch.setattr(boosting, "ROWS_EXACT", 7)
    many = boosting.fit_second_order(rows, 300, 3, params)
    for column in ("feature", "threshold", "left", "right", "value", "gain"):
        np.testing.assert_array_equal(getattr(one, column), getattr(many, column))


def test_rows_find_their_nodes():
    bins = np.array([[0, 5], [3, 5], [3, 1], [9, 9]], np.int16)
    assert boosting._nodes({}, bins).tolist() == [1, 1, 1, 1]
    assert boosting._nodes({1: (0, 2), 3: (1, 4)}, bins).tolist() == [2, 7, 6, 7]


def test_recursive_groups_hold_no_more_trees_than_a_task_of_the_fit(waves, table):
    from dataclasses import replace

    model = replace(models.fit_model("random_forest", table, "patient", trees=2, depth=2), tasks=7)
    steps = forecasting.forecast_recursive(model, waves, forecasting.future_grid(waves, 2))
    assert "% 7" in (plan := steps._jdf.queryExecution().optimizedPlan().toString()) or ", 7)" in plan
    assert steps.where("predicted_glucose is null").count() == 0


def test_pooled_gradient_boosting_is_brute_force(spark):
    """Every split of up to 256 bins is tried, Spark's learner had 32; the first tree counts in full."""
    rng = np.random.default_rng(8)
    x, y = data(rng, 200)
    rows = spark.createDataFrame([(1, i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "patient_id long, h int, a double, b double, c double, glucose double")
    rows = rows.selectExpr("patient_id", "timestamp_seconds(3600 * h) AS hour_ts", "a", "b", "c", "glucose")
    model = models.fit_model("gradient_boosting", rows, iterations=3, depth=3, rate=0.3)
    got = model.predict(rows).orderBy("hour_ts").toPandas()["prediction"].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.full(len(y), y.mean())
    for rate in (1.0, 0.3, 0.3):
        tree = brute_tree(z, y - want, 3, 2, 1, 0.0)
        want = want + rate * np.array([follow(tree, row) for row in z])
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_one_job_boosts_the_rows_of_one_task(spark, monkeypatch):
    """Hundreds of short passes took most of the time on small tables; the trees are the same."""
    rng = np.random.default_rng(9)
    x, y = data(rng, 200)
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, label double").repartition(3).persist()
    params, context, jobs = {"iterations": 8, "depth": 3, "rate": 0.3}, spark.sparkContext, []

    def fitted(group):
        context.setJobGroup(group, group)
        try:
            return boosting.fit_second_order(rows, 200, 3, params)
        finally:
            jobs.append(len(context.statusTracker().getJobIdsForGroup(group)))
            context.setLocalProperty("spark.jobGroup.id", None)

    one = fitted("one task")
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 100)
    many = fitted("many tasks")
    assert jobs[0] <= 20 < jobs[1]
    for column in ("feature", "threshold", "left", "right", "value", "gain"):
        np.testing.assert_array_equal(getattr(one, column), getattr(many, column))


def test_rows_are_sorted_once_for_all_trees_of_a_patient(monkeypatch):
    rng = np.random.default_rng(10)
    x, y = data(rng, 90)
    of, patients, limits, sorts, lexsort = np.repeat([0, 1], [40, 50]), np.array([5, 6]), trees.Growth(4, 5, 2), [], np.lexsort
    bag = trees._bagged(patients, of, range(4), 42)
    level = np.bincount(of, y) / np.bincount(of)
    want, _ = trees.grow(x[bag[0]], (y - level[of])[bag[0]], bag[1], bag[2], 8, limits)  # sorts the drawn rows
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(1) or lexsort(keys))
    (forest,) = trees.grow_forest(patients, of, x, y, range(4), 1, limits, 42)
    assert len(sorts) == x.shape[1]
    for column in ("feature", "threshold", "n"):
        got = np.concatenate(forest.sort_values(["patient_id", "tree"])[column].to_list())
        np.testing.assert_array_equal(got, getattr(want, column)[np.argsort(want.root, kind="stable")])
    sorts.clear()
    trees.grow_boosted(patients, of, x, y, 6, 0.1, limits)
    assert len(sorts) == x.shape[1]
