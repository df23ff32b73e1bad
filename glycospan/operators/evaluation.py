"""Chronological holdout, error metrics and the comparison of algorithms."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycospan.functions.numeric import correlation
from glycospan.operators.models import check_algorithm, fit_model
from glycospan.session import durable


def chronological_split(rows: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Mark the first ``int(n * (1 - test_size))`` rows of each patient as training rows."""
    order = Window.partitionBy("patient_id").orderBy("hour_ts")
    whole = Window.partitionBy("patient_id")
    train_rows = F.floor(F.count("*").over(whole) * F.lit(1 - test_size))
    return rows.withColumn("is_train", F.row_number().over(order) <= train_rows)


def error_metrics(scored: DataFrame, by: tuple[str, ...] = ("patient_id", "algorithm")) -> DataFrame:
    """Eight metrics over ``actual`` and ``predicted`` in one pass.

    Rows with a missing side are left out and counted in ``skipped``.
    """
    a, p = F.col("actual"), F.col("predicted")
    both = a.isNotNull() & p.isNotNull()
    a, p = F.when(both, a), F.when(both, p)
    error = F.abs(p - a)
    return scored.groupBy(*by).agg(
        F.count_if(both).alias("n"),
        F.count_if(~both).alias("skipped"),
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(a - p, a))) * 100).alias("mape"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop(a) * F.count(a))).alias("r2"),
        F.max(error).alias("max_error"),
        F.median(error).alias("median_error"),
        correlation(a, p).alias("correlation"),
        F.try_divide(F.count_if(error <= 20) * F.lit(100.0), F.count(error)).alias("within_20"),
    )


def mae_band(mae: Column) -> Column:
    return (
        F.when(mae < 15, "Excellent")
        .when(mae < 25, "Good")
        .when(mae < 35, "Acceptable")
        .when(mae.isNotNull(), "Poor")
    )


def r2_band(r2: Column) -> Column:
    return (
        F.when(r2 > 0.8, "Excellent")
        .when(r2 > 0.6, "Good")
        .when(r2 > 0.4, "Moderate")
        .when(r2.isNotNull(), "Poor")
    )


def with_bands(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns(
        {"mae_band": mae_band(F.col("mae")), "r2_band": r2_band(F.col("r2"))}
    )


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Metrics with bands and the rank of each algorithm by three orders, per patient.

    The name breaks ties. A patient has one row per algorithm here.
    """
    patient = Window.partitionBy("patient_id")

    def place(column: Column) -> Column:
        return F.row_number().over(patient.orderBy(column, "algorithm"))

    return with_bands(metrics).withColumns(
        {
            "mae_rank": place(F.asc_nulls_last("mae")),
            "r2_rank": place(F.desc_nulls_last("r2")),
            "within_20_rank": place(F.desc_nulls_last("within_20")),
        }
    )


def band_counts(metrics: DataFrame) -> DataFrame:
    """How many algorithms of a patient fall in each error band."""
    bands = ("Excellent", "Good", "Acceptable", "Poor")
    band = mae_band(F.col("mae"))
    return metrics.groupBy("patient_id").agg(
        *[F.count_if(band == b).alias(b.lower()) for b in bands],
        F.min_by("algorithm", F.struct("mae", "algorithm")).alias("best_by_mae"),
        F.min("mae").alias("best_mae"),
    )


def score_holdout(
    name: str,
    table: DataFrame,
    test_size: float = 0.2,
    in_sample: bool = False,
    scope: str = "pooled",
    **params,
) -> DataFrame:
    """Fit on the training rows and predict the held-out rows.

    ``table`` holds feature rows, or the hourly grid for ``prophet``. ``in_sample``
    fits on all rows, as scoring a model that has seen the test rows does.
    """
    split = chronological_split(table, test_size)
    known = split if in_sample else split.where("is_train")
    model = fit_model(name, known.drop("is_train"), scope, **params)
    held_out = split.where(~F.col("is_train")).drop("is_train")
    return model.predict(held_out).select(
        "patient_id",
        F.lit(name).alias("algorithm"),
        "hour_ts",
        F.col("glucose").alias("actual"),
        F.col("prediction").alias("predicted"),
    )


def backtest(name: str, table: DataFrame, **options) -> DataFrame:
    return error_metrics(score_holdout(name, table, **options))


def _in_own_pool(context, name: str, work):
    """Run ``work`` with its jobs in a scheduler pool of their own; what still runs when it fails is cancelled."""
    tag = f"compare-{name}-{uuid.uuid4().hex}"
    context.setLocalProperty("spark.scheduler.pool", name)
    context.addJobTag(tag)
    try:
        return work()
    except Exception:
        context.cancelJobsWithTag(tag)
        raise
    finally:
        context.removeJobTag(tag)
        context.setLocalProperty("spark.scheduler.pool", None)


#: Algorithms of many passes, which are started before the others.
LONGEST = ("svr", "random_forest", "gradient_boosting", "xgboost")


def compare_algorithms(
    hourly: DataFrame,
    features: DataFrame,
    names,
    params: dict[str, dict] | None = None,
    parallel: int = 4,
    **options,
) -> DataFrame:
    """Leaderboard of several algorithms, with a ``failure`` where there is nothing to rank.

    Up to ``parallel`` algorithms are fitted and scored at a time, each in a scheduler pool of
    its own, the longest first, so that the short stages of one fill the gaps of another (pools
    share fairly where ``spark.scheduler.mode`` is FAIR). Each algorithm's metrics, one row per patient, are made
    here, so that one that fails while it is fitted or in a task gets a ``failure`` and leaves
    the others alone. A patient that an algorithm cannot score says why.
    """
    for name in names:
        check_algorithm(name)
    context = features.sparkSession.sparkContext

    def scored(name: str) -> DataFrame:
        table = hourly if name == "prophet" else features
        return durable(backtest(name, table, **options, **(params or {}).get(name, {})))

    with ThreadPoolExecutor(max(1, parallel)) as threads:
        runs = {
            name: threads.submit(inheritable_thread_target(features.sparkSession)(_in_own_pool), context, name, partial(scored, name))
            for name in sorted(names, key=lambda name: name not in LONGEST)
        }
    results, failed = [], []
    for name in names:
        if (problem := (run := runs[name]).exception()) is None:
            results.append(run.result())
        else:  # one failing fit must not stop the others
            failed.append(
                features.select("patient_id")
                .distinct()
                .withColumns({"algorithm": F.lit(name), "failure": F.lit(str(problem))})
            )
    if not results:
        raise RuntimeError("no algorithm could be fitted")
    board = leaderboard(reduce(DataFrame.unionByName, results))
    board = board.withColumn("failure", F.when(F.col("n") == 0, F.lit("no prediction: no training rows or no fit")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), failed, board)
