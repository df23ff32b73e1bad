"""Scoring rows with models that are rows themselves, by hash groups of patients."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for two tables of one origin that meet in a group."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


#: From a group's model rows and its patients: which patients have a model, and a function of
#: inputs (rows x columns) and the place of each row's patient among them.
Build = Callable[[pd.DataFrame, pd.Index], tuple[np.ndarray, Callable]]


def add_predictions(rows: DataFrame, models: DataFrame, columns: list[str], build: Build, tasks: int) -> DataFrame:
    """``rows`` with ``prediction``: null for patients without a model and for rows with a missing input."""
    kept = rows.columns
    task = F.pmod(F.xxhash64(F.col("patient_id").cast("long")), F.lit(tasks))

    def score(asked: pa.Table, fitted: pa.Table) -> pa.Table:
        asked = asked.select(kept)
        inputs = [asked.column(c).to_numpy().astype(float) for c in columns]
        x = np.column_stack(inputs) if inputs else np.zeros((asked.num_rows, 0))
        ids = asked.column("patient_id").to_pandas()
        who = pd.Index(ids.dropna().unique())
        place = who.get_indexer(ids)
        known, values = build(fitted.to_pandas(), who)
        ok = (place >= 0) & ~np.isnan(x).any(axis=1)
        ok[ok] = known[place[ok]]
        out = np.full(len(ids), np.nan)
        if ok.any():
            out[ok] = values(x[ok], place[ok])
        return asked.append_column("prediction", pa.array(out, pa.float64(), mask=~ok))

    left, right = rows.withColumn("_task", task), renewed(models).withColumn("_task", task)
    schema = rows.withColumn("prediction", F.lit(None).cast("double")).schema
    return left.groupBy("_task").cogroup(right.groupBy("_task")).applyInArrow(score, schema)


def group_count(rows: DataFrame, n: int, together: int) -> int:
    """Hash groups for ``n`` rows: of about ``together`` rows, and enough of them for all cores."""
    by_size = 1 + n // together
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return by_size if by_size >= cores else max(by_size, min(cores, rows.select("patient_id").distinct().count()))
