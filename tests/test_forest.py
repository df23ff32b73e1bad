"""Forests over all patients: tops from histograms, the rest in tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospan.operators import forest, trees


def rows_of(spark, n, seed, inputs=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, (n, inputs)).astype(float)
    y = x[:, 0] * (x[:, 1] > 20) + rng.normal(0, 3, n)
    rows = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "key long, x array<double>, label double")
    return rows.repartition(3), x, y


def predicted(spark, model, x):
    columns = [f"c{i}" for i in range(x.shape[1])]
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"{c} double" for c in columns))
    return np.array([r.prediction for r in model.add_prediction(rows.repartition(2), columns).orderBy("i").collect()])


PARAMS = {"trees": 6, "depth": 7, "min_split": 5, "min_leaf": 2, "seed": 3}


@pytest.mark.parametrize("below, together", [(10**6, 256), (60, 256), (60, 4)])
def test_trees_are_those_of_the_drawn_rows_wherever_they_are_grown(spark, monkeypatch, below, together):
    monkeypatch.setattr(forest, "ROWS_BELOW", below)
    monkeypatch.setattr(forest, "OPEN_TOGETHER", together)
    rows, x, y = rows_of(spark, 500, 1)
    model = forest.fit_forest(rows, 500, 3, PARAMS)
    assert any(t.splits for t in model.tops.values()) == (below == 60)
    bins = np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(model.cuts)])
    times = forest.multiplicity(np.arange(500), np.arange(6), 3).astype(np.int64)
    wanted, most = np.zeros(500), 0
    for tree in range(6):
        drawn = np.flatnonzero(times[:, tree])
        target = np.rint(y[drawn] * 2**24) / 2**24
        nodes, _ = trees.grow(bins[drawn], target, times[drawn, tree], np.zeros(len(drawn), np.int64), 1, trees.Growth(7, 5, 2))
        leaf = trees.descend(nodes.feature, nodes.threshold, nodes.left, nodes.right, np.zeros(500, np.int64), bins, np.arange(500))
        wanted += nodes.value[leaf] / 6
        most = max(most, len(nodes.feature))
    assert most > 15
    np.testing.assert_allclose(predicted(spark, model, x), wanted, atol=1e-7)
    np.testing.assert_allclose(model.flat().values(x), wanted, atol=1e-7)
    shares = model.shares(3)
    assert sum(shares) == pytest.approx(1) and min(shares[:2]) > shares[2]


def test_a_pooled_forest_splits_no_node_of_fewer_rows_than_asked(spark):
    from glycospan.operators import models

    data = [(1, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", float(i % 7), float(i % 7)) for i in range(200)]
    table = spark.createDataFrame(data, "patient_id long, t string, glucose double, glucose_lag_1h double")
    table = table.select("patient_id", F.to_timestamp("t").alias("hour_ts"), "glucose", "glucose_lag_1h")
    model = models.fit_model("random_forest", table, trees=3, min_split=1000)
    assert model.predict(table).select("prediction").distinct().count() == 1


def test_draws_are_with_replacement_and_differ_from_tree_to_tree():
    times = forest.multiplicity(np.arange(20_000), np.arange(3), 42)
    shares = np.bincount(times[:, 0], minlength=4)[:4] / 20_000
    np.testing.assert_allclose(shares, [0.3679, 0.3679, 0.1839, 0.0613], atol=0.012)
    assert abs(np.corrcoef(times.T.astype(float))[0, 1]) < 0.03


def test_a_node_too_large_for_a_task_that_cannot_be_split_is_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(forest, "ROWS_BELOW", 10)
    rows = spark.createDataFrame([(i, [1.0], float(i % 2)) for i in range(100)], "key long, x array<double>, label double")
    model = forest.fit_forest(rows, 100, 1, PARAMS | {"trees": 2})
    times = forest.multiplicity(np.arange(100), np.arange(2), 3).astype(float)
    wanted = np.mean([times[1::2, k].sum() / times[:, k].sum() for k in range(2)])
    assert predicted(spark, model, np.ones((1, 1)))[0] == pytest.approx(wanted)
