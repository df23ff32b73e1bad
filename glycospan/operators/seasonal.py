"""Seasonal-trend forecasters of the hourly grid.

``fit_seasonal_trend`` is a least-squares trend times an hour-of-week index and is
made of aggregates only. ``fit_fourier_trend`` is a piecewise-linear trend times
daily and weekly Fourier terms, solved per patient by small ridge systems.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycospan.functions.calendar import weekday

# executors get the helpers of this module with the task, not from their own disk
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: normal quantile of a two-sided 95% interval
Z95 = 1.959963984540054


def _hours_since(ts: Column, origin: Column) -> Column:
    return (F.unix_seconds(ts) - F.unix_seconds(origin)) / F.lit(3600.0)


def _slot(ts: Column) -> Column:
    return (weekday(ts) * 24 + F.hour(ts)).cast("int")


@dataclass(frozen=True)
class SeasonalTrend:
    """One row per patient: the line, the spread, and the index by slot and by hour."""

    table: DataFrame

    algorithm = "prophet"

    def predict(self, rows: DataFrame, ts: str = "timestamp") -> DataFrame:
        """Add prediction, 95% bounds and trend to rows with patient and time.

        An hour of the week that was never seen takes the index of its hour of day.
        """
        t = F.col(ts)
        trend = F.col("intercept") + F.col("slope") * _hours_since(t, F.col("first_ts"))
        season = F.coalesce(
            F.try_element_at("by_slot", _slot(t)), F.try_element_at("by_hour", F.hour(t)), F.lit(1.0)
        )
        yhat, spread = F.col("predicted_glucose"), Z95 * F.col("sigma")
        return (
            rows.join(self.table, "patient_id", "left")
            .withColumn("trend", trend)
            .withColumn("predicted_glucose", F.col("trend") * season)
            .withColumn("lower_bound", yhat - spread)
            .withColumn("upper_bound", yhat + spread)
            .select(*rows.columns, "predicted_glucose", "lower_bound", "upper_bound", "trend")
        )


def fit_seasonal_trend(history: DataFrame) -> SeasonalTrend:
    """Trend by least squares on hours since the first row; index by hour of week.

    Every step groups within a patient, so the history is laid out by patient once
    and the whole fit runs in that layout.
    """
    patient = Window.partitionBy("patient_id")
    y, x, trend = F.col("glucose"), F.col("x"), F.col("trend")
    known = (
        history.withColumn("first_ts", F.min("hour_ts").over(patient))
        .where(y.isNotNull())
        .withColumn("x", _hours_since(F.col("hour_ts"), F.col("first_ts")))
        .withColumn("slope", F.coalesce(F.regr_slope(y, x).over(patient), F.lit(0.0)))
        .withColumn(
            "intercept", F.avg(y).over(patient) - F.col("slope") * F.avg(x).over(patient)
        )
        .withColumn("trend", F.col("intercept") + F.col("slope") * x)
        .withColumn("share", F.try_divide(y, trend))
    )
    line = ["patient_id", "first_ts", "slope", "intercept"]
    slots = known.groupBy(*line, _slot(F.col("hour_ts")).alias("slot")).agg(
        F.avg("share").alias("slot_index"),
        F.sum("share").alias("total"),
        F.count("share").alias("n"),
        # with y, t and s per row: sum (y - t s)^2 = sum y^2 - 2 s sum t y + s^2 sum t^2
        F.sum(y * y).alias("yy"),
        F.sum(y * trend).alias("ty"),
        F.sum(trend * trend).alias("tt"),
    )
    s = F.coalesce("slot_index", F.lit(1.0))
    squares = F.sum(F.col("yy") - 2 * s * F.col("ty") + s * s * F.col("tt"))
    hour = F.col("slot") % 24
    same_hour = Window.partitionBy("patient_id", hour)
    hour_index = F.try_divide(F.sum("total").over(same_hour), F.sum("n").over(same_hour))
    # at most 168 slots per patient
    table = (
        slots.withColumn("hour_index", hour_index)
        .groupBy(*line)
        .agg(
            F.sqrt(F.greatest(F.try_divide(squares, F.sum("n")), F.lit(0.0))).alias("sigma"),
            F.map_from_entries(F.collect_list(F.struct("slot", "slot_index"))).alias("by_slot"),
            F.map_from_entries(F.collect_set(F.struct(hour.alias("hour"), "hour_index"))).alias(
                "by_hour"
            ),
        )
    )
    return SeasonalTrend(table)


# Fourier orders and changepoint settings of the trend model.
DAILY_ORDER = 8
WEEKLY_ORDER = 3
CHANGEPOINTS = 25
CHANGEPOINT_SPAN = 0.8
CHANGEPOINT_PRIOR = 0.05
SEASONALITY_PRIOR = 10.0


def _fourier(hours: np.ndarray) -> np.ndarray:
    waves = [(24.0, k) for k in range(1, DAILY_ORDER + 1)]
    waves += [(168.0, k) for k in range(1, WEEKLY_ORDER + 1)]
    angles = np.column_stack([2 * np.pi * k * hours / period for period, k in waves])
    return np.hstack([np.sin(angles), np.cos(angles)])


#: Largest change of the (scaled) trend in a round that counts as none; past the last round ``last_move`` tells.
FOURIER_TOLERANCE, FOURIER_ROUNDS = 1e-9, 500


def _hinges(at: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones_like(at), at, np.maximum(at[:, None] - knots[None, :], 0.0)])


def _ridge(design: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.linalg.solve(design.T @ design + np.diag(penalty), design.T @ y)


def _fit_fourier(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.dropna(subset=["glucose"]).sort_values("hour_ts")
    if pdf.empty:
        return pd.DataFrame(columns=list(_FOURIER_FIELDS))
    hours = pdf["hour_ts"].to_numpy().astype("datetime64[s]").astype("int64") / 3600.0
    y = pdf["glucose"].to_numpy(dtype=float)
    span = max(hours[-1] - hours[0], 1.0)
    at, scale = (hours - hours[0]) / span, max(np.abs(y).max(), 1e-9)
    knots = np.linspace(0, CHANGEPOINT_SPAN, CHANGEPOINTS + 2)[1:-1]

    trend_design = _hinges(at, knots)
    noise = 0.1  # relative noise level against which the priors are weighed
    hinge_penalty = np.r_[1e-6, 1e-6, np.full(len(knots), (noise / CHANGEPOINT_PRIOR) ** 2)]
    trend_coef = _ridge(trend_design, y / scale, hinge_penalty)
    waves = _fourier(hours)
    season_penalty = np.full(waves.shape[1], (noise / SEASONALITY_PRIOR) ** 2)
    season_coef = np.zeros(waves.shape[1])
    moved, rounds = np.inf, 0
    # trend and seasonality are each linear given the other: in turns until the fit stands still
    while moved > FOURIER_TOLERANCE and rounds < FOURIER_ROUNDS:
        rounds += 1
        trend = trend_design @ trend_coef
        season_coef = _ridge(waves * trend[:, None], y / scale - trend, season_penalty)
        factor = 1.0 + waves @ season_coef
        before = trend_design @ trend_coef
        trend_coef = _ridge(trend_design * factor[:, None], y / scale, hinge_penalty)
        moved = float(np.abs(trend_design @ trend_coef - before).max())
    fitted = (trend_design @ trend_coef) * (1.0 + waves @ season_coef) * scale
    return pd.DataFrame(
        {
            "patient_id": [pdf["patient_id"].iloc[0]],
            "first_hour": [hours[0]],
            "span_hours": [span],
            "scale": [scale],
            "trend_coef": [trend_coef],
            "season_coef": [season_coef],
            "sigma": [float(np.sqrt(np.mean((y - fitted) ** 2)))],
            "last_move": [moved],
        }
    )


_FOURIER_FIELDS = {
    "patient_id": "long",
    "first_hour": "double",
    "span_hours": "double",
    "scale": "double",
    "trend_coef": "array<double>",
    "season_coef": "array<double>",
    "sigma": "double",
    "last_move": "double",
}


def _dot(left: list[Column], right: Column) -> Column:
    terms = F.zip_with(F.array(*left), right, lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)


@dataclass(frozen=True)
class FourierTrend:
    """Coefficients, one row per patient; scoring is a column expression."""

    coefficients: DataFrame

    algorithm = "prophet"

    def predict(self, rows: DataFrame, ts: str = "timestamp") -> DataFrame:
        hours = F.col("at_hour")
        waves = [(24.0, k) for k in range(1, DAILY_ORDER + 1)]
        waves += [(168.0, k) for k in range(1, WEEKLY_ORDER + 1)]
        angles = [hours * F.lit(2 * np.pi * k / period) for period, k in waves]
        at = (hours - F.col("first_hour")) / F.col("span_hours")
        knots = np.linspace(0, CHANGEPOINT_SPAN, CHANGEPOINTS + 2)[1:-1]
        hinges = [F.lit(1.0), at, *[F.greatest(at - F.lit(float(k)), F.lit(0.0)) for k in knots]]
        season = 1 + _dot([F.sin(a) for a in angles] + [F.cos(a) for a in angles], F.col("season_coef"))
        yhat, spread = F.col("predicted_glucose"), Z95 * F.col("sigma")
        return (
            rows.withColumn("at_hour", F.unix_seconds(ts) / F.lit(3600.0))
            .join(self.coefficients, "patient_id", "left")
            .withColumn("trend", _dot(hinges, F.col("trend_coef")) * F.col("scale"))
            .withColumn("predicted_glucose", F.col("trend") * season)
            .withColumn("lower_bound", yhat - spread)
            .withColumn("upper_bound", yhat + spread)
            .select(*rows.columns, "predicted_glucose", "lower_bound", "upper_bound", "trend")
        )


def fit_fourier_trend(history: DataFrame) -> FourierTrend:
    """One small solve per patient, over at most one row per hour of calendar time."""
    schema = ", ".join(f"{k} {t}" for k, t in _FOURIER_FIELDS.items())
    fitted = (
        history.select("patient_id", "hour_ts", "glucose")
        .groupBy("patient_id")
        .applyInPandas(_fit_fourier, schema)
    )
    return FourierTrend(fitted)
