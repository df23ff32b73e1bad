"""Exact nearest-neighbour regression per patient."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycospan.operators.grouped import group_count

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: query rows that are compared at a time, and training rows of a task
BLOCK, ROWS_TOGETHER = 2048, 20_000


def _nearest_means(queries: np.ndarray, known: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Mean target of the k nearest rows; earlier rows win ties.

    Distances from one matrix product, which rounds, leave few candidates: all rows that could
    be among the k nearest. Only their distances are summed up column by column.
    """
    k = min(k, len(y))
    out = np.empty(len(queries))
    chunk = max(1, 4_000_000 // max(len(y), 1))
    lengths = (known * known).sum(axis=1)
    for at in range(0, len(queries), chunk):
        part = queries[at : at + chunk]
        own = (part * part).sum(axis=1)
        rough = own[:, None] + lengths - 2 * (part @ known.T)
        reach = np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = 1e-11 * (own + lengths.max(initial=0.0)) + 1e-300
        i, j = np.nonzero(rough <= (reach + slack)[:, None])
        distance = np.zeros(len(i))
        for c in range(known.shape[1]):
            distance += (part[i, c] - known[j, c]) ** 2
        order = np.lexsort((j, distance, i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(len(part)))
        # added by size, so that the same rows have the same mean in whatever order they are near
        out[at : at + len(part)] = np.sort(y[j[first[:, None] + np.arange(k)]], axis=1).mean(axis=1)
    return out


def predict_neighbours(
    train: DataFrame,
    queries: DataFrame,
    columns: list[str],
    target: str = "glucose",
    k: int = 5,
    prediction: str = "prediction",
) -> DataFrame:
    """Mean target of the ``k`` nearest ``train`` rows of the patient, per query row.

    Rows of a patient are compared block-wise inside a task, so no pair of rows is
    ever produced. Queries are cut into blocks of 2048 and the training rows of
    the patient (at most one per hour of calendar time) go to each of its blocks.
    A task takes a hash group of blocks, as there may be many patients with few rows.
    """
    tasks = group_count(train, train.count(), ROWS_TOGETHER)
    number = F.row_number().over(Window.partitionBy("patient_id").orderBy("hour_ts"))
    asked = queries.where(F.col("patient_id").isNotNull()).select("patient_id", "hour_ts", *columns).withColumn(
        "block", F.floor((number - 1) / F.lit(BLOCK))
    )
    blocks = asked.groupBy(F.col("patient_id").alias("owner")).agg(F.max("block").alias("last"))
    known = (
        train.select(
            F.col("patient_id").alias("owner"),
            F.col("hour_ts").alias("known_ts"),
            F.col(target).alias("known_target"),
            *[F.col(c).alias(f"known_{c}") for c in columns],
        )
        .join(blocks, "owner")
        .withColumn("known_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        .drop("last")
    )

    def task(patient: str, block: str) -> Column:
        return F.pmod(F.xxhash64(F.col(patient).cast("long"), F.col(block).cast("long")), F.lit(tasks))

    def per_task(known_pdf: pd.DataFrame, asked_pdf: pd.DataFrame) -> pd.DataFrame:
        known_pdf = known_pdf.sort_values("known_ts")
        values = np.full(len(asked_pdf), np.nan)
        x, near = asked_pdf[columns].to_numpy(float), known_pdf[[f"known_{c}" for c in columns]].to_numpy(float)
        y = known_pdf["known_target"].to_numpy(float)
        places = known_pdf.groupby(["owner", "known_block"]).indices
        for key, rows in asked_pdf.groupby(["patient_id", "block"]).indices.items():
            if key in places:
                values[rows] = _nearest_means(x[rows], near[places[key]], y[places[key]], k)
        return asked_pdf[["patient_id", "hour_ts"]].assign(**{prediction: values})

    return (
        known.withColumn("task", task("owner", "known_block")).groupBy("task")
        .cogroup(asked.withColumn("task", task("patient_id", "block")).groupBy("task"))
        .applyInPandas(per_task, f"patient_id long, hour_ts timestamp, {prediction} double")
        .withColumn(prediction, F.when(~F.isnan(prediction), F.col(prediction)))
    )
