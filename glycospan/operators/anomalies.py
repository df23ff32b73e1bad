"""Reading-level anomaly flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glycospan.config import DEFAULTS, Settings
from glycospan.functions.calendar import minutes_between
from glycospan.operators.slices import SLICE, slice_context, slice_readings

# The flags, which are also the words of the label, in label order.
FLAGS = ("sensor_error", "statistical_outlier", "sudden_change")

#: named subsets of the flagged readings
SUBSETS = {
    "all": "anomaly",
    "sensor_errors": "sensor_error",
    "statistical_outliers": "statistical_outlier",
    "sudden_changes": "sudden_change",
    "data_gaps": "data_gap",
}


def sensor_errors(readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Flag values outside the valid range; needs no shuffle."""
    v = F.col("value")
    outside = (v < settings.min_valid) | (v > settings.max_valid)
    return readings.withColumn("sensor_error", F.coalesce(outside, F.lit(False)))


def flag_anomalies(readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every reading with its deltas, the four flags and the label.

    The readings are shuffled once, by slice; the window and the join with the
    slice context both use that layout.
    """
    rows, summary = slice_readings(readings, settings)
    context = slice_context(summary)
    order = Window.partitionBy(*SLICE).orderBy("timestamp", "id")
    v, t = F.col("value"), F.col("timestamp")

    joined = (
        rows.withColumn("leads_slice", F.row_number().over(order) == 1)
        .withColumn("lag_time", F.lag("timestamp").over(order))
        .withColumn("lag_value", F.lag("value").over(order))
        .join(context, SLICE, "left")
    )
    previous_time = F.when(F.col("leads_slice"), F.col("before_time")).otherwise(F.col("lag_time"))
    previous_value = F.when(F.col("leads_slice"), F.col("before_value")).otherwise(F.col("lag_value"))
    diff, minutes = F.col("glucose_diff"), F.col("time_diff")

    sudden = F.when(minutes == 0, diff != 0).otherwise(
        F.abs(F.col("rate_of_change")) > settings.rate_limit
    )
    outlier = F.col("patient_varies") & (
        F.abs(v - F.col("patient_mean")) > settings.z_limit * F.col("patient_std")
    )
    flagged = (
        joined.withColumn("glucose_diff", v - previous_value)
        .withColumn("time_diff", minutes_between(t, previous_time))
        .withColumn("rate_of_change", F.try_divide(diff, minutes))
        .transform(sensor_errors, settings)
        .withColumn("statistical_outlier", F.coalesce(outlier, F.lit(False)))
        .withColumn("sudden_change", F.coalesce(sudden, F.lit(False)))
        .withColumn("data_gap", F.coalesce(minutes > settings.gap_minutes, F.lit(False)))
    )
    return (
        flagged.withColumn(
            "anomaly",
            F.col("sensor_error") | F.col("statistical_outlier") | F.col("sudden_change"),
        )
        .withColumn(
            "anomaly_type",
            F.concat(*[F.when(F.col(f), f + ",").otherwise("") for f in FLAGS]),
        )
        .select(
            *readings.columns,
            "glucose_diff",
            "time_diff",
            "rate_of_change",
            *FLAGS,
            "data_gap",
            "anomaly",
            "anomaly_type",
        )
    )


def label_array(flagged: DataFrame) -> DataFrame:
    """The label as an array of names instead of one string."""
    names = F.array_compact(F.array(*[F.when(F.col(f), f) for f in FLAGS]))
    return flagged.withColumn("anomaly_types", names)


def anomaly_subset(flagged: DataFrame, name: str = "all") -> DataFrame:
    """One of the five named subsets; ``data_gaps`` carries ``gap_duration``."""
    if name not in SUBSETS:
        raise ValueError(f"unknown subset {name!r}; one of {sorted(SUBSETS)}")
    rows = flagged.where(F.col(SUBSETS[name]))
    if name == "data_gaps":
        rows = rows.withColumn("gap_duration", F.col("time_diff"))
    return rows


def tag_subsets(flagged: DataFrame) -> DataFrame:
    """One row per reading and subset it belongs to, in a single pass."""
    names = F.array_compact(F.array(*[F.when(F.col(f), n) for n, f in SUBSETS.items()]))
    return flagged.withColumn("subset", F.explode(names))


def anomaly_counts(flagged: DataFrame, with_total: bool = False) -> DataFrame:
    """Counts by flag in one pass, ``with_total`` that of all readings too."""
    total = [F.count("*").alias("total_readings")] if with_total else []
    return flagged.groupBy("patient_id").agg(
        *total,
        F.count_if("sensor_error").alias("sensor_errors"),
        F.count_if("statistical_outlier").alias("statistical_outliers"),
        F.count_if("sudden_change").alias("sudden_changes"),
        F.count_if("data_gap").alias("data_gaps"),
        F.count_if("anomaly").alias("total_anomalies"),
    )
