import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospan.operators import evaluation, features
from glycospan.operators.models import ALGORITHMS


def test_split_takes_whole_rows_per_patient(make_hourly):
    rows = make_hourly([(1, h, 1) for h in range(7)] + [(2, h, 1) for h in range(10)])
    split = evaluation.chronological_split(rows)
    got = split.groupBy("patient_id").agg(F.count_if("is_train").alias("n")).orderBy("patient_id").collect()
    assert [r.n for r in got] == [int(7 * (1 - 0.2)), int(10 * (1 - 0.2))]
    late = split.where("patient_id = 1").groupBy("is_train").agg(F.max("hour_ts").alias("t")).collect()
    times = {r.is_train: r.t for r in late}
    assert times[True] < times[False]


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    actual = rng.normal(140, 30, 50)
    predicted = actual + rng.normal(0, 15, 50)
    rows = [(1, "a", float(x), float(y)) for x, y in zip(actual, predicted)] + [(1, "a", None, 3.0)]
    got = evaluation.error_metrics(
        spark.createDataFrame(rows, "patient_id long, algorithm string, actual double, predicted double")
    ).first()
    error = np.abs(actual - predicted)
    assert got.n == 50 and got.skipped == 1
    assert got.mae == pytest.approx(error.mean())
    assert got.rmse == pytest.approx(np.sqrt((error**2).mean()))
    assert got.mape == pytest.approx((error / actual).mean() * 100)
    assert got.r2 == pytest.approx(1 - (error**2).sum() / ((actual - actual.mean()) ** 2).sum())
    assert got.max_error == pytest.approx(error.max())
    assert got.median_error == pytest.approx(np.median(error))
    assert got.correlation == pytest.approx(np.corrcoef(actual, predicted)[0, 1])
    assert got.within_20 == pytest.approx((error <= 20).mean() * 100)


def test_constant_actual_has_no_correlation(spark):
    rows = [(1, "a", 100.0, float(v)) for v in (99, 100, 102)]
    got = evaluation.error_metrics(
        spark.createDataFrame(rows, "patient_id long, algorithm string, actual double, predicted double")
    ).first()
    assert got.correlation is None and got.r2 is None and got.mae == 1.0


def test_bands(spark):
    rows = spark.createDataFrame(
        [(14.9, 0.81), (15.0, 0.8), (25.0, 0.6), (35.0, 0.4)], "mae double, r2 double"
    )
    got = [(r.mae_band, r.r2_band) for r in evaluation.with_bands(rows).orderBy("mae").collect()]
    assert got == [
        ("Excellent", "Excellent"),
        ("Good", "Good"),
        ("Acceptable", "Moderate"),
        ("Poor", "Poor"),
    ]


def test_comparison_ranks_all_algorithms(waves):
    small = {
        "random_forest": {"trees": 3, "depth": 4},
        "gradient_boosting": {"iterations": 2, "depth": 3},
        "xgboost": {"iterations": 2, "depth": 3},
        "svr": {"waves": 32},
    }
    table = features.build_features(waves, leak_free=True).persist()
    board = evaluation.compare_algorithms(waves, table, ALGORITHMS, small).persist()
    assert board.where("failure is not null").count() == 0
    assert board.count() == 2 * len(ALGORITHMS)
    first = board.where("patient_id = 1").orderBy("mae_rank").collect()
    assert [r.mae for r in first] == sorted(r.mae for r in first)
    counts = evaluation.band_counts(board).where("patient_id = 1").first()
    assert counts.excellent + counts.good + counts.acceptable + counts.poor == len(ALGORITHMS)
    assert counts.best_by_mae == first[0].algorithm


def test_failures_are_listed(waves):
    table = features.build_features(waves, leak_free=True).persist()
    board = evaluation.compare_algorithms(waves, table, ("ridge", "lasso"), {"lasso": {"alpha": -1.0}})
    failed = board.where("failure is not null").select("algorithm").distinct().collect()
    assert [r.algorithm for r in failed] == ["lasso"]
    assert board.where("failure is null").count() == 2


def test_in_sample_scores_differ(waves):
    table = features.build_features(waves).persist()
    seen = evaluation.backtest("decision_tree", table, in_sample=True).agg(F.avg("mae")).first()[0]
    unseen = evaluation.backtest("decision_tree", table).agg(F.avg("mae")).first()[0]
    assert seen < unseen


def test_an_algorithm_that_fails_in_a_task_leaves_the_others(waves, monkeypatch):
    table = features.build_features(waves, leak_free=True)
    plain = evaluation.backtest

    def late(name, rows, **options):
        metrics = plain(name, rows, **options)
        broken = F.raise_error(F.lit("fails in a task")).cast("double")
        return metrics.withColumn("mae", broken) if name == "ridge" else metrics

    monkeypatch.setattr(evaluation, "backtest", late)
    board = evaluation.compare_algorithms(waves, table, ("prophet", "ridge"), scope="patient").collect()
    failed = [r for r in board if r.algorithm == "ridge"]
    assert len(failed) == 2 and all("fails in a task" in r.failure for r in failed)
    assert all(r.failure is None and r.mae > 0 for r in board if r.algorithm == "prophet")


def test_patients_that_cannot_be_scored_are_listed(make_hourly):
    rows = make_hourly([(1, h, 100 + h % 24) for h in range(100)] + [(2, 0, 120.0)])
    board = evaluation.compare_algorithms(rows, rows, ("prophet",)).collect()
    found = {r.patient_id: r for r in board}
    assert found[2].n == 0 and found[2].skipped == 1 and "no prediction" in found[2].failure
    assert found[1].failure is None


def test_algorithms_compared_at_once_give_the_same_board(waves):
    table = features.build_features(waves, leak_free=True).persist()
    names = ("ridge", "knn", "decision_tree", "prophet")
    options = {"scope": "patient", "params": {"decision_tree": {"depth": 3}}}
    one = evaluation.compare_algorithms(waves, table, names, parallel=1, **options).orderBy("patient_id", "algorithm").collect()
    four = evaluation.compare_algorithms(waves, table, names, parallel=4, **options).orderBy("patient_id", "algorithm").collect()
    assert one == four and len(one) == 8


def test_jobs_of_an_algorithm_have_their_pool_and_lose_it(spark):
    context = spark.sparkContext
    seen = evaluation._in_own_pool(context, "ridge", lambda: (context.getLocalProperty("spark.scheduler.pool"), len(context.getJobTags())))
    assert seen == ("ridge", 1)
    assert context.getLocalProperty("spark.scheduler.pool") is None and not context.getJobTags()
    with pytest.raises(ZeroDivisionError):
        evaluation._in_own_pool(context, "ridge", lambda: 1 / 0)
    assert not context.getJobTags()


def test_long_fits_are_started_first(waves, monkeypatch):
    started = []

    def backtest(name, table):
        started.append(name)
        return evaluation.error_metrics(table.selectExpr("patient_id", f"'{name}' AS algorithm", "glucose AS actual", "glucose AS predicted"))

    monkeypatch.setattr(evaluation, "backtest", backtest)
    board = evaluation.compare_algorithms(waves, waves, ("ridge", "svr", "knn"), parallel=1)
    assert started == ["svr", "ridge", "knn"]
    assert board.groupBy("algorithm").count().count() == 3
