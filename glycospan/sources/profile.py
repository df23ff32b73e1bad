"""Summaries of a readings table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glycospan.functions.calendar import whole_days


def table_statistics(readings: DataFrame) -> DataFrame:
    """Count, time range and value statistics per patient (population deviation)."""
    return readings.groupBy("patient_id").agg(
        F.count("*").alias("total_records"),
        F.min("timestamp").alias("earliest_date"),
        F.max("timestamp").alias("latest_date"),
        F.avg("value").alias("avg_glucose"),
        F.min("value").alias("min_glucose"),
        F.max("value").alias("max_glucose"),
        F.stddev_pop("value").alias("std_glucose"),
    )


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, nullability and null / distinct counts of every column.

    One column-pruned scan per column, each counting distinct values by a shuffle on
    the value itself: no wide expansion of the rows, no set held by one task. A value
    that fills the column is collapsed before its shuffle. ``approx`` counts distinct
    values by a mergeable sketch instead, all columns in one scan.
    """
    def one(position: int, field) -> DataFrame:
        col = F.col(f"`{field.name}`")
        return (
            df.groupBy(col.alias("v"))
            .agg(F.count("*").alias("n"))
            .agg(
                F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
                F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
                F.count("v").alias("distinct_values"),
            )
            .select(
                F.lit(position).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(field.nullable).alias("nullable"),
                "non_null",
                "nulls",
                "distinct_values",
            )
        )

    if approx:
        return _sketched_profile(df)
    return reduce(
        DataFrame.unionByName, [one(i, f) for i, f in enumerate(df.schema.fields)]
    )


def _sketched_profile(df: DataFrame) -> DataFrame:
    aggregates, rows = [], []
    for i, field in enumerate(df.schema.fields):
        col = F.col(f"`{field.name}`")
        aggregates += [F.count(col).alias(f"k{i}"), F.approx_count_distinct(col).alias(f"d{i}")]
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(field.nullable).alias("nullable"),
                F.col(f"k{i}").alias("non_null"),
                (F.col("n") - F.col(f"k{i}")).alias("nulls"),
                F.col(f"d{i}").alias("distinct_values"),
            )
        )
    return df.agg(F.count("*").alias("n"), *aggregates).select(F.inline(F.array(*rows)))


def preview(readings: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` readings of the whole table (a distributed top-k)."""
    return readings.orderBy("timestamp", "id").limit(n)


def preview_per_patient(readings: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` readings of every patient.

    Spark cuts each map task to ``n`` rows per patient before the shuffle.
    """
    w = Window.partitionBy("patient_id").orderBy("timestamp", "id")
    return readings.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def load_summary(readings: DataFrame) -> DataFrame:
    return readings.groupBy("patient_id").agg(
        F.count("*").alias("records"),
        F.min("timestamp").alias("first_reading"),
        F.max("timestamp").alias("last_reading"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )


def view_summary(df: DataFrame, view: str) -> DataFrame:
    """Rows, time range, whole days and value range of a ``raw`` or ``cleaned`` view."""
    time_col, value_col = {
        "raw": ("timestamp", "value"),
        "cleaned": ("hour_ts", "glucose"),
    }[view]
    return (
        df.groupBy("patient_id")
        .agg(
            F.min(time_col).alias("from_time"),
            F.max(time_col).alias("to_time"),
            F.count("*").alias("n_rows"),
            F.min(value_col).alias("min_value"),
            F.max(value_col).alias("max_value"),
        )
        .withColumn("duration_days", whole_days(F.col("to_time"), F.col("from_time")))
        .withColumn("data_view", F.lit(view))
    )


def dataset_summary(readings: DataFrame, hourly: DataFrame) -> DataFrame:
    """Raw and hourly row counts with the cleaned time range, per patient."""
    raw = readings.groupBy("patient_id").agg(F.count("*").alias("raw_readings"))
    clean = hourly.groupBy("patient_id").agg(
        F.count("*").alias("hourly_rows"),
        F.min("hour_ts").alias("from_time"),
        F.max("hour_ts").alias("to_time"),
    )
    return raw.join(clean, "patient_id", "left").withColumn(
        "duration_days", whole_days(F.col("to_time"), F.col("from_time"))
    )
