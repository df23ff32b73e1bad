"""Cut the readings of a patient into time-ordered slices of bounded size.

A window over all readings of one patient would put a busy patient into a single
task. Readings are cut by day instead, and a day that is itself too full is cut
again by a range shuffle on (timestamp, id). Slices keep the order of the
readings, so "the previous reading" is either in the same slice or is the last
reading of the slice before it, and only one small row per slice has to cross.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycospan.config import DEFAULTS, Settings
from glycospan.session import durable

SLICE = ["patient_id", "slice", "part"]
#: Readings that a task of the range shuffle takes at least, however small the parts are.
ROWS_PER_TASK = 250_000


def _slice_number(hours: int) -> Column:
    """Slices since the epoch; readings without a time sort before all others."""
    return F.coalesce(
        F.floor(F.unix_seconds("timestamp") / F.lit(3600.0 * hours)), F.lit(-(2**62))
    )


def _summarise(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SLICE).agg(
        F.count("*").alias("n_rows"),
        F.max(F.struct("timestamp", "id", "value")).alias("last"),
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("var"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )


def slice_readings(readings: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """``(rows, summary)``: readings with ``slice`` and ``part``, and one row per slice.

    Runs one pre-aggregated pass to size the slices and keeps its small result.
    """
    rows = readings.withColumn("slice", _slice_number(settings.slice_hours)).withColumn("part", F.lit(0).cast("long"))
    summary = durable(_summarise(rows))
    total, largest = summary.agg(F.sum("n_rows"), F.max("n_rows")).first()
    limit = settings.crowded_above(total or 0)
    if (largest or 0) <= limit:
        return rows, summary

    key = ["patient_id", "slice"]
    crowded = F.broadcast(summary.where(F.col("n_rows") > limit).select(*key))
    in_crowded = summary.where(F.col("n_rows") > limit).agg(F.sum("n_rows")).first()[0]
    split = durable(
        rows.join(crowded, key, "left_semi")
        .repartitionByRange(2 * (in_crowded // max(limit, ROWS_PER_TASK) + 1), "patient_id", "timestamp", "id")
        .sortWithinPartitions("patient_id", "timestamp", "id")
        # numbers rise by 1 inside a range and jump between ranges, so parts of ``limit`` keep the order
        .withColumn("part", F.expr(f"monotonically_increasing_id() div {limit}") + 1)
    )
    rows = rows.join(crowded, key, "left_anti").unionByName(split)
    summary = summary.where(F.col("n_rows") <= limit).unionByName(
        _summarise(split)
    )
    return rows, summary


def slice_context(summary: DataFrame) -> DataFrame:
    """What a slice needs from outside: the reading before it and the patient's moments.

    One row per slice, so a patient has about one per day of calendar time here and a
    window over the patient is bounded.
    """
    patient = Window.partitionBy("patient_id")
    n, mean = F.col("n"), F.col("mean")
    return (
        summary.withColumn(
            "before", F.lag("last").over(patient.orderBy("slice", "part"))
        )
        .withColumn("patient_n", F.sum("n").over(patient))
        .withColumn(
            "patient_mean",
            F.try_divide(F.sum(mean * n).over(patient), F.col("patient_n")),
        )
        .withColumn(
            "patient_std",
            F.sqrt(
                F.try_divide(
                    F.sum(F.col("var") * n + n * F.pow(mean - F.col("patient_mean"), 2)).over(patient),
                    F.col("patient_n"),
                )
            ),
        )
        .withColumn(
            "patient_varies",
            F.max("highest").over(patient) > F.min("lowest").over(patient),
        )
        .select(
            *SLICE,
            F.col("before.timestamp").alias("before_time"),
            F.col("before.value").alias("before_value"),
            "patient_mean",
            "patient_std",
            "patient_varies",
        )
    )
