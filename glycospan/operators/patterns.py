"""Patterns, distributions and ranges of a value over time.

These read the hourly grid (or a forecast), where a patient has at most one row per
hour of calendar time; every grouping is combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycospan.config import COMPARED_HORIZONS, DEFAULTS, Settings
from glycospan.functions.calendar import weekday, whole_days
from glycospan.functions.numeric import percent


def _profile(df: DataFrame, key: Column, name: str, value: str) -> DataFrame:
    mean, std = F.col("mean_glucose"), F.col("std_glucose")
    return (
        df.groupBy("patient_id", key.alias(name))
        .agg(
            F.avg(value).alias("mean_glucose"),
            F.stddev_samp(value).alias("std_glucose"),
            F.count(value).alias("hours"),
        )
        .withColumns({"band_low": mean - std, "band_high": mean + std})
    )


def hour_profile(df: DataFrame, value: str = "glucose", ts: str = "hour_ts") -> DataFrame:
    return _profile(df, F.hour(ts), "hour", value)


def weekday_profile(df: DataFrame, value: str = "glucose", ts: str = "hour_ts") -> DataFrame:
    return _profile(df, weekday(F.col(ts)), "day_of_week", value)


def peak_and_trough(profile: DataFrame, key: str) -> DataFrame:
    """Keys of the highest and lowest mean; the smallest key wins a tie."""
    mean = F.col("mean_glucose")
    known = profile.where(mean.isNotNull())
    return known.groupBy("patient_id").agg(
        F.max_by(key, F.struct(mean, -F.col(key))).alias(f"peak_{key}"),
        F.max("mean_glucose").alias("peak_mean"),
        F.min_by(key, F.struct(mean, F.col(key))).alias(f"trough_{key}"),
        F.min("mean_glucose").alias("trough_mean"),
    )


def linear_trend(hourly: DataFrame, value: str = "glucose") -> DataFrame:
    """Least squares of the value on the row number 0..n-1.

    All columns are null when a value is missing, as there is no fit then.
    """
    order = Window.partitionBy("patient_id").orderBy("hour_ts")
    y, x = F.col(value), F.col("x")
    complete = F.count(y) == F.count("*")
    fit = (
        hourly.withColumn("x", (F.row_number().over(order) - 1).cast("double"))
        .groupBy("patient_id")
        .agg(
            F.when(complete, F.regr_slope(y, x)).alias("slope"),
            F.when(complete, F.regr_intercept(y, x)).alias("intercept"),
            F.when(complete, F.regr_r2(y, x)).alias("r2"),
        )
    )
    direction = F.when(F.col("slope") > 0, "increasing").when(
        F.col("slope").isNotNull(), "decreasing"
    )
    return fit.withColumn("direction", direction)


def variability(df: DataFrame, value: str = "glucose") -> DataFrame:
    return (
        df.groupBy("patient_id")
        .agg(F.stddev_samp(value).alias("std_glucose"), F.avg(value).alias("mean_glucose"))
        .withColumn("cv_percent", percent(F.col("std_glucose"), F.col("mean_glucose")))
    )


def distribution_summary(df: DataFrame, value: str = "glucose") -> DataFrame:
    return df.groupBy("patient_id").agg(
        F.avg(value).alias("mean_glucose"),
        F.median(value).alias("median_glucose"),
        F.stddev_samp(value).alias("std_glucose"),
        F.min(value).alias("min_glucose"),
        F.max(value).alias("max_glucose"),
    )


def range_counts(value: str, settings: Settings = DEFAULTS) -> list[Column]:
    v = F.col(value)
    low, high = settings.range_low, settings.range_high
    parts = {
        "below": v < low,
        "in_range": v.between(low, high),
        "above": v > high,
    }
    counts = [F.count_if(p).alias(f"{name}_hours") for name, p in parts.items()]
    shares = [
        percent(F.count_if(p), F.count("*")).alias(f"{name}_percent") for name, p in parts.items()
    ]
    return [F.count("*").alias("total_hours"), *counts, *shares]


def time_in_range(
    df: DataFrame, value: str = "glucose", settings: Settings = DEFAULTS
) -> DataFrame:
    """Hours and shares below, in and above the target range.

    Hours without a value count in the total.
    """
    return df.groupBy("patient_id").agg(*range_counts(value, settings))


def histogram(df: DataFrame, bins: int = 50, value: str = "glucose") -> DataFrame:
    """Equal-width bins from minimum to maximum; the last one is closed.

    Empty bins are listed. A patient with a single value has all rows in one bin
    of width 1 around it, as plotting libraries draw it.
    """
    # one exchange: edges, counts and empty bins are all made in the layout by patient
    patient, v = Window.partitionBy("patient_id"), F.col("v")
    ranges = (
        df.where(F.col(value).isNotNull())
        .select("patient_id", F.col(value).alias("v"))
        .withColumns({"least": F.min("v").over(patient), "most": F.max("v").over(patient)})
    )
    flat = F.col("least") == F.col("most")
    edges = {
        "lo": F.when(flat, F.col("least") - 0.5).otherwise(F.col("least")),
        "hi": F.when(flat, F.col("most") + 0.5).otherwise(F.col("most")),
    }
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    bin_ = F.least(F.floor((v - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = (
        ranges.withColumns(edges)
        .withColumn("width", width)
        .groupBy("patient_id", "lo", "width", bin_.alias("bin"))
        .agg(F.count("*").alias("n"))
        .groupBy("patient_id", "lo", "width")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("filled"))  # at most ``bins`` entries
    )
    every = counts.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.select(
        "patient_id",
        "bin",
        (F.col("lo") + F.col("width") * F.col("bin")).alias("bin_low"),
        (F.col("lo") + F.col("width") * (F.col("bin") + 1)).alias("bin_high"),
        F.coalesce(F.try_element_at("filled", "bin"), F.lit(0).cast("long")).alias("n"),
    )


def box_plot(df: DataFrame, value: str = "glucose") -> DataFrame:
    """Quartiles, whiskers at the furthest points within 1.5 IQR, and outliers."""
    # quartiles stay in the layout by patient, so the rows are exchanged once
    v, patient = F.col(value), Window.partitionBy("patient_id")
    points = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(patient)
    rows = df.select("patient_id", value).withColumn("q", points)
    rows = rows.withColumns({"q1": F.col("q")[0], "median_glucose": F.col("q")[1], "q3": F.col("q")[2]})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        rows.groupBy("patient_id", "q1", "median_glucose", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def daily_means(df: DataFrame, value: str = "predicted_glucose", ts: str = "timestamp") -> DataFrame:
    return df.groupBy("patient_id", F.to_date(ts).alias("date")).agg(
        F.avg(value).alias("mean_glucose"), F.count("*").alias("hours")
    )


def monthly_stats(df: DataFrame, value: str = "predicted_glucose", ts: str = "timestamp") -> DataFrame:
    return df.groupBy("patient_id", F.date_trunc("month", ts).alias("month")).agg(
        F.avg(value).alias("avg_glucose"),
        F.min(value).alias("min_glucose"),
        F.max(value).alias("max_glucose"),
        F.stddev_samp(value).alias("std_glucose"),
    )


def compare_horizons(
    forecast: DataFrame, horizons: dict[str, int] | None = None, value: str = "predicted_glucose"
) -> DataFrame:
    """Statistics of forecast prefixes, from one forecast as long as the longest.

    ``forecast`` has a ``step`` column counting from 1. All prefixes are aggregated
    in the same pass and laid out as rows afterwards.
    """
    horizons = horizons or COMPARED_HORIZONS
    v, step = F.col(value), F.col("step")
    rows = []
    for i, (name, hours) in enumerate(horizons.items()):
        part = F.when(step <= hours, v)
        rows.append(
            F.struct(
                F.lit(name).alias("period"),
                F.lit(hours).alias("period_hours"),
                F.col(f"n{i}").alias("hours"),
                F.col(f"avg{i}").alias("avg_glucose"),
                F.col(f"min{i}").alias("min_glucose"),
                F.col(f"max{i}").alias("max_glucose"),
                F.col(f"std{i}").alias("std_glucose"),
            )
        )
        stats = [
            F.count(part).alias(f"n{i}"),
            F.avg(part).alias(f"avg{i}"),
            F.min(part).alias(f"min{i}"),
            F.max(part).alias(f"max{i}"),
            F.stddev_samp(part).alias(f"std{i}"),
        ]
        aggregates = stats if i == 0 else aggregates + stats
    return forecast.groupBy("patient_id").agg(*aggregates).select("patient_id", F.inline(F.array(*rows)))


def slot_diversity(df: DataFrame, value: str = "predicted_glucose", ts: str = "timestamp") -> DataFrame:
    """Spread of the values at one weekday and hour, from week to week."""
    return df.groupBy(
        "patient_id", weekday(F.col(ts)).alias("day_of_week"), F.hour(ts).alias("hour")
    ).agg(F.count(value).alias("weeks"), F.stddev_pop(value).alias("std_glucose"))


def hourly_diversity(df: DataFrame, value: str = "predicted_glucose", ts: str = "timestamp") -> DataFrame:
    """Distinct values (to 0.1) per hour of day, averaged over the 24 hours."""
    per_hour = df.groupBy("patient_id", F.hour(ts).alias("hour")).agg(
        F.count_distinct(F.bround(F.col(value), 1)).alias("distinct_values")
    )
    return per_hour.groupBy("patient_id").agg(
        (F.sum("distinct_values") / F.lit(24.0)).alias("mean_distinct_values")
    )


def kpi_row(
    readings: DataFrame, hourly: DataFrame, anomaly_counts: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Total readings, mean, time in range and anomalies: one row per patient.

    Readings are counted in a pass of their own only if ``anomaly_counts`` has no ``total_readings``.
    """
    counted = "total_readings" in anomaly_counts.columns
    raw = readings.groupBy("patient_id").agg(F.count("*").alias("total_readings"))
    clean = hourly.groupBy("patient_id").agg(
        F.avg("glucose").alias("avg_glucose"),
        percent(
            F.count_if(F.col("glucose").between(settings.range_low, settings.range_high)),
            F.count("*"),
        ).alias("time_in_range_percent"),
    )
    if counted:
        raw = anomaly_counts.select("patient_id", "total_readings", "total_anomalies")
        return raw.join(clean, "patient_id", "left").select("patient_id", "total_readings", "avg_glucose", "time_in_range_percent", "total_anomalies")
    anomalies = anomaly_counts.select("patient_id", "total_anomalies")
    return raw.join(clean, "patient_id", "left").join(anomalies, "patient_id", "left")


def dashboard(
    hourly: DataFrame, anomaly_counts: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """The numbers of the overview panel, one row per patient."""
    stats = hourly.groupBy("patient_id").agg(
        F.count("*").alias("total_readings"),
        F.min("hour_ts").alias("from_time"),
        F.max("hour_ts").alias("to_time"),
        F.avg("glucose").alias("mean_glucose"),
        F.median("glucose").alias("median_glucose"),
        F.stddev_samp("glucose").alias("std_glucose"),
        F.min("glucose").alias("min_glucose"),
        F.max("glucose").alias("max_glucose"),
        *range_counts("glucose", settings)[4:],
    )
    return stats.withColumn(
        "duration_days", whole_days(F.col("to_time"), F.col("from_time"))
    ).join(anomaly_counts.select("patient_id", "total_anomalies"), "patient_id", "left")


def plot_series(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast in one table, split at the last reading of the history.

    Forecast rows up to that time are the fitted values.
    """
    last = history.groupBy("patient_id").agg(F.max("hour_ts").alias("last_ts"))
    actual = history.select(
        "patient_id",
        F.col("hour_ts").alias("timestamp"),
        F.lit("actual").alias("series"),
        F.col("glucose").alias("value"),
        F.lit(None).cast("double").alias("lower_bound"),
        F.lit(None).cast("double").alias("upper_bound"),
        F.lit(False).alias("is_future"),
    )
    is_future = F.col("timestamp") > F.col("last_ts")
    predicted = forecast.join(last, "patient_id").select(
        "patient_id",
        "timestamp",
        F.when(is_future, "forecast").otherwise("fitted").alias("series"),
        F.col("predicted_glucose").alias("value"),
        F.when(is_future, F.col("lower_bound")).alias("lower_bound"),
        F.when(is_future, F.col("upper_bound")).alias("upper_bound"),
        is_future.alias("is_future"),
    )
    return actual.unionByName(predicted)
