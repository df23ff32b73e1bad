"""Rows of the clinical report, from future forecast rows (``ds``, ``yhat``, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycospan.config import DEFAULTS, Settings
from glycospan.functions.numeric import percent
from glycospan.functions.ranges import period_label, range_status, range_text, severity


def report_input(forecast: DataFrame) -> DataFrame:
    """Future rows under the report's column names."""
    return forecast.where("is_future").select(
        "patient_id",
        F.col("timestamp").alias("ds"),
        F.col("predicted_glucose").alias("yhat"),
        F.col("lower_bound").alias("yhat_lower"),
        F.col("upper_bound").alias("yhat_upper"),
    )


def report_metrics(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    y, low, high = F.col("yhat"), settings.range_low, settings.range_high
    n = F.count("*")
    return (
        rows.groupBy("patient_id")
        .agg(
            n.alias("n"),
            F.avg(y).alias("average"),
            F.min(y).alias("minimum"),
            F.max(y).alias("maximum"),
            F.stddev_pop(y).alias("deviation"),
            percent(F.count_if(y.between(low, high)), n).alias("in_range"),
            percent(F.count_if(y < low), n).alias("below_range"),
            percent(F.count_if(y > high), n).alias("above_range"),
            F.min_by("yhat", "ds").alias("first_prediction"),
            F.max_by("yhat", "ds").alias("last_prediction"),
        )
        .withColumn("hba1c", estimated_hba1c(F.col("average")))
        .withColumn("period", period_label(F.col("n")))
    )


def estimated_hba1c(mean):
    # The linear relation of mean glucose and HbA1c.
    return (mean + 46.7) / 28.7


# Name, source column, unit and reference table of each parameter.
PARAMETERS = [
    ("Average Glucose", "average", "mg/dL", "Average Glucose"),
    ("Estimated HbA1c", "hba1c", "%", "HbA1c Equivalent"),
    ("Minimum Predicted", "minimum", "mg/dL", "Random Glucose"),
    ("Maximum Predicted", "maximum", "mg/dL", "Random Glucose"),
]
# Name, source column, goal, and the words for met and missed.
GOALS = [
    ("Time in Range (70-180)", "in_range", ">", 70, "Needs Improvement"),
    ("Time Below Range (<70)", "below_range", "<", 4, "High"),
    ("Time Above Range (>180)", "above_range", "<", 25, "High"),
]


def goal_status(share, sign: str, limit: float, missed: str):
    met = share > limit if sign == ">" else share < limit
    return F.when(met, "Good").when(share.isNotNull(), missed)


def report_rows(metrics: DataFrame) -> DataFrame:
    """Four parameters (positive values only) and three range goals per patient.

    Values are rounded half-even: to whole mg/dL, or one decimal of a percentage.
    """
    rows = []
    for i, (name, column, unit, table) in enumerate(PARAMETERS):
        v = F.col(column)
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("parameter"),
                v.alias("value"),
                F.bround(v, 1 if unit == "%" else 0).alias("shown_value"),
                F.lit(unit).alias("unit"),
                F.lit(range_text(table)).alias("reference_range"),
                range_status(v, table).alias("status"),
                (v > 0).alias("listed"),
            )
        )
    for i, (name, column, sign, limit, missed) in enumerate(GOALS, start=len(PARAMETERS)):
        v = F.col(column)
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("parameter"),
                v.alias("value"),
                F.bround(v, 1).alias("shown_value"),
                F.lit("%").alias("unit"),
                F.lit(f"{sign}{limit}% recommended").alias("reference_range"),
                goal_status(v, sign, limit, missed).alias("status"),
                F.lit(True).alias("listed"),
            )
        )
    return (
        metrics.select("patient_id", F.inline(F.array(*rows)))
        .where("listed")
        .drop("listed")
        .withColumn("severity", severity(F.col("status")))
    )
