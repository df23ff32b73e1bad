"""Future rows, their features, noise, bounds and summaries."""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycospan.config import DEFAULTS, NAMED_HORIZONS, Settings
from glycospan.functions.calendar import STEP_SECONDS, is_weekend, plus_seconds
from glycospan.functions.numeric import clip, gaussian
from glycospan.operators.features import calendar_columns, input_columns
from glycospan.operators.grouped import renewed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORECAST = ("timestamp", "predicted_glucose", "lower_bound", "upper_bound", "trend")


# --- future rows -----------------------------------------------------------


def horizon(name: str) -> int:
    """Hours of a named horizon."""
    if name not in NAMED_HORIZONS:
        raise ValueError(f"unknown horizon {name!r}; one of {', '.join(NAMED_HORIZONS)}")
    return NAMED_HORIZONS[name]


def last_times(history: DataFrame) -> DataFrame:
    return history.groupBy("patient_id").agg(F.max("hour_ts").alias("last_ts"))


def _first_step(last: Column, freq: str, whole_step: bool) -> Column:
    """Start of the grid: the next hour, or the next whole step with ``whole_step``.

    Weekly grids fall on Sundays at the time of day of the start.
    """
    if freq == "W":
        start = last + F.expr("INTERVAL 1 DAY") if whole_step else last + F.expr("INTERVAL 1 HOUR")
        return plus_seconds(start, (6 - F.weekday(start)) * 86400)
    return plus_seconds(last, F.lit(STEP_SECONDS[freq] if whole_step else 3600))


def future_grid(
    history: DataFrame, periods: int, freq: str = "H", whole_step: bool = False
) -> DataFrame:
    """``periods`` future rows per patient: ``step`` 1.. and ``timestamp``."""
    if freq not in STEP_SECONDS:
        raise ValueError(f"freq must be H, D or W, not {freq!r}")
    step = F.explode(F.sequence(F.lit(1), F.lit(periods)))
    return (
        last_times(history)
        .withColumn("first_ts", _first_step(F.col("last_ts"), freq, whole_step))
        .select("patient_id", "last_ts", "first_ts", step.alias("step"))
        .withColumn(
            "timestamp",
            plus_seconds(F.col("first_ts"), (F.col("step") - 1) * F.lit(STEP_SECONDS[freq])),
        )
        .drop("first_ts")
    )


def range_grid(history: DataFrame, start: str, end: str, parity: bool = False) -> DataFrame:
    """Hourly future rows that fall in ``[start, end]``.

    ``parity`` counts the rows of the range from the end of the history, so a
    range that starts later is cut short or empty; by default the grid reaches
    ``end``.
    """
    start_ts, end_ts = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")

    def hours(later: Column, earlier: Column) -> Column:
        return F.floor((F.unix_seconds(later) - F.unix_seconds(earlier)) / F.lit(3600.0))

    wanted = hours(end_ts, start_ts) + 1 if parity else hours(end_ts, F.col("last_ts"))
    first = (
        F.lit(1).cast("long")
        if parity
        else F.greatest(F.lit(1).cast("long"), hours(start_ts, F.col("last_ts")))
    )
    return (
        last_times(history)
        .withColumn("first_step", first)
        .withColumn("steps", wanted)
        .where(F.col("steps") >= F.col("first_step"))
        .select(
            "patient_id",
            "last_ts",
            F.explode(F.sequence(F.col("first_step"), F.col("steps"))).alias("step"),
        )
        .withColumn("step", F.col("step").cast("int"))
        .withColumn("timestamp", plus_seconds(F.col("last_ts"), F.col("step") * F.lit(3600)))
        .where(F.col("timestamp").between(start_ts, end_ts))
    )


# --- features of future rows -----------------------------------------------


def future_features(features: DataFrame, grid: DataFrame, mode: str = "frozen") -> DataFrame:
    """Model inputs for the rows of ``grid``.

    ``frozen`` repeats the last known state of the patient and moves the calendar
    on; ``zero_fill`` knows the calendar only and sets every other input to 0.
    """
    columns = input_columns(features)
    known = calendar_columns("timestamp") | {"is_weekend": is_weekend(F.col("timestamp"))}
    known = {c: col for c, col in known.items() if c in columns}
    state = [c for c in columns if c not in known]
    if mode == "zero_fill":
        rows = grid.withColumns(known | {c: F.lit(0.0) for c in state})
    elif mode == "frozen":
        last = features.groupBy("patient_id").agg(
            F.max_by(F.struct(*state), "hour_ts").alias("state")
        )
        rows = grid.join(last, "patient_id").withColumns(
            known | {c: F.col(f"state.{c}") for c in state}
        )
    else:
        raise ValueError(f"mode must be frozen or zero_fill, not {mode!r}")
    return rows.withColumn("hour_ts", F.col("timestamp")).select(
        *grid.columns, "hour_ts", *columns
    )


def forecast_with_model(
    model, features: DataFrame, grid: DataFrame, mode: str = "frozen"
) -> DataFrame:
    """Predictions of a fitted regressor on future rows; the trend is the prediction."""
    scored = model.predict(future_features(features, grid, mode))
    return scored.select(
        *grid.columns,
        F.col("prediction").alias("predicted_glucose"),
        F.col("prediction").alias("trend"),
    )


#: Hours of history that a recursive forecast starts from, and patients that a task steps together.
STATE_HOURS, PATIENTS_PER_TASK = 168, 4_000


def _inputs(column: str) -> tuple[str, int]:
    """What an input of the feature table is made of: (kind, hours)."""
    part = column.split("_")
    if column in ("glucose_rolling_mean", "glucose_rolling_std"):
        return f"week_{part[2]}", STATE_HOURS
    if part[0] != "glucose":
        return column, 0
    if part[1] == "rolling":
        return f"rolling_{part[2]}", int(part[3][:-1])
    return part[1], int(part[2][:-1])


def _roll_forward(
    state: np.ndarray, clock: dict[str, np.ndarray], columns: list[str], score, noise: np.ndarray
) -> np.ndarray:
    """Predict step by step, feeding predictions back; one array operation per step and input.

    ``state`` has a row per patient and a column per hour, the newest last; ``clock`` and
    ``noise`` have a column per step.
    """
    steps = noise.shape[1]
    values = np.concatenate((state, np.full((len(state), steps), np.nan)), axis=1)
    made = {
        "lag": lambda past, k: past[:, -k],
        "diff": lambda past, k: past[:, -1] - past[:, -1 - k],
        "rolling_mean": lambda past, k: past[:, -k:].mean(axis=1),
        "rolling_std": lambda past, k: past[:, -k:].std(axis=1, ddof=1),
        "week_mean": lambda past, k: np.nanmean(past[:, -k:], axis=1),
        "week_std": lambda past, k: np.nanstd(past[:, -k:], axis=1),
    }
    wanted = [_inputs(c) for c in columns]
    for i in range(steps):
        past = values[:, : state.shape[1] + i]
        row = [clock[kind][:, i] if kind in clock else made[kind](past, k) for kind, k in wanted]
        values[:, state.shape[1] + i] = score(np.column_stack(row).astype(float)) + noise[:, i]
    return values[:, state.shape[1] :]


def forecast_recursive(
    model,
    history: DataFrame,
    grid: DataFrame,
    noise: float | None = None,
    seed: int = 0,
    patients_per_task: int = PATIENTS_PER_TASK,
) -> DataFrame:
    """Step-by-step forecast of any model that has a ``stepper``: linear, kernel and tree models.

    A stepper is a table of model rows by patient, and a function that makes of the rows of a
    group and its patients (which of them are known, predictions from inputs and places).
    ``history`` is the hourly grid. Each prediction becomes the newest value of the lags and
    windows of the next row, starting from the 168 hours up to the grid's last known time;
    an hour without a value takes the straight line between its neighbours, so a lag is
    always so many hours back. Fit on ``leak_free`` features: there a row sees only earlier
    values, as it does here. With a ``noise`` scale the noise of a step is part of the
    value that is fed back. Patients are stepped together in groups by hash; one whose
    known hours don't reach back as far as the longest lag or window gets null.
    """
    if not hasattr(model, "stepper"):
        raise ValueError(f"{model.algorithm} has no recursive forecast")
    columns = model.columns
    table, build = model.stepper()
    needed = 1 + max([k for kind, k in map(_inputs, columns) if not kind.startswith("week")], default=0)
    ends = grid.groupBy("patient_id").agg(F.max("last_ts").alias("last_ts"))
    back = (F.unix_seconds("last_ts") - F.unix_seconds("hour_ts")) / F.lit(3600)
    recent = (
        history.where(F.col("glucose").isNotNull())
        .join(ends, "patient_id")
        .withColumn("back", F.floor(back))
        .where(F.col("back").between(0, STATE_HOURS - 1))
        .select(
            "patient_id",
            (-F.col("back")).cast("int").alias("step"),
            F.col("hour_ts").alias("timestamp"),
            "glucose",
            F.lit(0.0).alias("noise"),
        )
    )
    ahead_rows = grid.select(
        "patient_id", "step", "timestamp", F.lit(None).cast("double").alias("glucose")
    )
    if noise:
        ahead_rows = with_noise_column(ahead_rows, history, noise, seed)
    else:
        ahead_rows = ahead_rows.withColumn("noise", F.lit(0.0))
    # trees and kernels of a patient may be far larger than its rows: their models know how many fit a task
    tasks = max(1 + ends.count() // patients_per_task, getattr(model, "tasks", 1))
    task = F.pmod(F.hash(F.col("patient_id").cast("long")), F.lit(tasks))
    rows = recent.unionByName(ahead_rows).withColumn("task", task)

    def run(pdf: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["patient_id", "step"])
        past, ahead = pdf[pdf["step"] <= 0], pdf[pdf["step"] > 0]
        steps = int(ahead["step"].max()) if len(ahead) else 0
        who = ahead.drop_duplicates("patient_id").reset_index(drop=True)
        place = pd.Series(who.index, index=who["patient_id"])
        state = np.full((len(who), STATE_HOURS), np.nan)
        past = past[past["patient_id"].isin(place.index)]
        state[place[past["patient_id"]], STATE_HOURS - 1 + past["step"]] = past["glucose"]
        for row in state:  # unknown hours between known ones, and after the last
            known = np.flatnonzero(~np.isnan(row))
            if len(known):
                row[known[0] :] = np.interp(np.arange(known[0], STATE_HOURS), known, row[known])
        at = (place[ahead["patient_id"]].to_numpy(), ahead["step"].to_numpy() - 1)
        when = pd.DatetimeIndex(ahead["timestamp"])

        def by_step(values) -> np.ndarray:
            table = np.zeros((len(who), steps))
            table[at] = values
            return table

        clock = {
            "hour": by_step(when.hour),
            "day_of_week": by_step(when.dayofweek),
            "day_of_month": by_step(when.day),
            "month": by_step(when.month),
            "is_weekend": by_step(when.dayofweek >= 5),
        }
        known, values = build(fitted, pd.Index(who["patient_id"]))
        enough = ~np.isnan(state[:, STATE_HOURS - needed :]).any(axis=1) if len(who) else np.zeros(0, bool)
        enough &= known
        predicted = np.full((len(who), steps), np.nan)
        if enough.any():
            some = np.flatnonzero(enough)
            predicted[enough] = _roll_forward(
                state[enough],
                {k: v[enough] for k, v in clock.items()},
                columns,
                lambda x: values(x, some),
                by_step(ahead["noise"].to_numpy(float))[enough],
            )
        return ahead[["patient_id", "step"]].assign(predicted_glucose=predicted[at])

    done = (
        rows.groupBy("task")
        .cogroup(renewed(table).withColumn("task", task).groupBy("task"))
        .applyInPandas(run, "patient_id long, step int, predicted_glucose double")
    )
    done = done.withColumn(
        "predicted_glucose",
        F.when(~F.isnan("predicted_glucose"), F.col("predicted_glucose")),
    )
    return grid.join(done, ["patient_id", "step"], "left").select(
        *grid.columns, "predicted_glucose", F.col("predicted_glucose").alias("trend")
    )


# --- noise, bounds and the forecast table ----------------------------------


def history_spread(history: DataFrame) -> DataFrame:
    """Deviation of the history per patient."""
    return history.groupBy("patient_id").agg(F.stddev_samp("glucose").alias("hist_std"))


def with_noise_column(
    future: DataFrame, history: DataFrame, scale: float = 0.20, seed: int = 0
) -> DataFrame:
    """Add ``noise``: a draw of the patient's spread plus half a draw of the hour's spread.

    The draws depend on patient, time and seed only.
    """
    by_hour = history.groupBy("patient_id", F.hour("hour_ts").alias("noise_hour")).agg(
        F.stddev_samp("glucose").alias("hour_std")
    )
    keys = (F.col("patient_id"), F.unix_micros("timestamp"))
    base = gaussian(*keys, seed=seed, stream=1) * F.col("hist_std") * scale
    hourly = (
        gaussian(*keys, seed=seed, stream=2)
        * F.coalesce("hour_std", "hist_std")
        * (scale * 0.5)
    )
    return (
        future.withColumn("noise_hour", F.hour("timestamp"))
        .join(history_spread(history), "patient_id", "left")
        .join(by_hour, ["patient_id", "noise_hour"], "left")
        .select(*future.columns, F.coalesce(base + hourly, F.lit(0.0)).alias("noise"))
    )


def add_noise(
    future: DataFrame, history: DataFrame, scale: float = 0.20, seed: int = 0
) -> DataFrame:
    """Add the noise to the prediction; ``trend`` moves with it."""
    return (
        with_noise_column(future, history, scale, seed)
        .withColumn("predicted_glucose", F.col("predicted_glucose") + F.col("noise"))
        .withColumn("trend", F.col("predicted_glucose"))
        .select(*future.columns)
    )


def add_seasonal_noise(
    forecast: DataFrame, history: DataFrame, scale: float = 0.20, seed: int = 0
) -> DataFrame:
    """Noise of the seasonal forecaster: one draw on the mean, one shared by both bounds."""
    keys = (F.col("patient_id"), F.unix_micros("timestamp"))
    spread = F.coalesce(F.col("hist_std"), F.lit(0.0)) * scale
    on_mean = gaussian(*keys, seed=seed, stream=1) * spread
    on_bounds = gaussian(*keys, seed=seed, stream=3) * spread * 0.5
    moved = {"predicted_glucose": on_mean, "lower_bound": on_bounds, "upper_bound": on_bounds}
    return (
        forecast.join(history_spread(history), "patient_id", "left")
        .withColumns(
            {
                c: F.when(F.col("is_future"), F.col(c) + draw).otherwise(F.col(c))
                for c, draw in moved.items()
            }
        )
        .select(*forecast.columns)
    )


def add_bounds(
    future: DataFrame,
    history: DataFrame,
    method: str = "spread",
    noisy: bool = False,
    residuals: DataFrame | None = None,
    seed: int = 0,
) -> DataFrame:
    """Bounds around the prediction.

    ``spread`` is twice a fifth of the history's deviation (a quarter, times a draw
    around 1, when the forecast is noisy). ``residual`` is 1.96 deviations of
    ``residuals`` (a table of patient and ``residual_std``), a 95% interval.
    """
    if method == "residual":
        table = residuals.select("patient_id", F.col("residual_std").alias("unit"))
        half = F.col("unit") * 1.96
    elif method == "spread":
        table = history_spread(history).withColumnRenamed("hist_std", "unit")
        half = F.col("unit") * (2 * 0.25 if noisy else 2 * 0.2)
        if noisy:
            draw = gaussian(F.col("patient_id"), F.unix_micros("timestamp"), seed=seed, stream=4)
            half = half * (F.lit(1.0) + draw * 0.1)
    else:
        raise ValueError(f"method must be spread or residual, not {method!r}")
    p = F.col("predicted_glucose")
    return (
        future.join(table, "patient_id", "left")
        .withColumns({"lower_bound": p - half, "upper_bound": p + half})
        .drop("unit")
    )


def residual_spread(scored: DataFrame) -> DataFrame:
    """Deviation of the errors of held-out rows (patient, actual, predicted), for 95% bounds."""
    error = F.col("actual") - F.col("predicted")
    return scored.groupBy("patient_id").agg(F.stddev_samp(error).alias("residual_std"))


def history_rows(history: DataFrame) -> DataFrame:
    """History in the shape of a forecast: every figure is the value itself."""
    value = F.col("glucose")
    return history.select(
        "patient_id",
        F.col("hour_ts").alias("timestamp"),
        *[value.alias(c) for c in FORECAST[1:]],
        F.lit(False).alias("is_future"),
    )


def with_history(future: DataFrame, history: DataFrame) -> DataFrame:
    return history_rows(history).unionByName(
        future.select("patient_id", *FORECAST).withColumn("is_future", F.lit(True))
    )


def clip_forecast(forecast: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Keep prediction and bounds in the valid range; the trend is left as it is."""
    return forecast.withColumns(
        {
            c: clip(F.col(c), settings.min_valid, settings.max_valid)
            for c in ("predicted_glucose", "lower_bound", "upper_bound")
        }
    )


def within(forecast: DataFrame, start: str, end: str) -> DataFrame:
    """Forecast rows from ``start`` to ``end``, both included."""
    return forecast.where(
        F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    )


def future_only(forecast: DataFrame) -> DataFrame:
    return forecast.where("is_future")


def seasonal_forecast(
    model, history: DataFrame, grid: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Fitted history and forecast of a seasonal model in one clipped table."""
    past = history.select("patient_id", F.col("hour_ts").alias("timestamp"))
    rows = past.withColumn("is_future", F.lit(False)).unionByName(
        grid.select("patient_id", "timestamp").withColumn("is_future", F.lit(True))
    )
    table = model.predict(rows).select("patient_id", *FORECAST, "is_future")
    if hasattr(model, "with_drawn_bounds"):
        table = model.with_drawn_bounds(table)
    return clip_forecast(table, settings)


def regressor_forecast(
    model,
    features: DataFrame,
    grid: DataFrame,
    mode: str = "frozen",
    noise: float | None = None,
    seed: int = 0,
    settings: Settings = DEFAULTS,
    hourly: DataFrame | None = None,
) -> DataFrame:
    """History and forecast of a feature-table model in one clipped table.

    ``noise`` is the noise scale; no noise by default. A recursive forecast starts from
    ``hourly``, the grid from which the features were made, as feature rows have gaps.
    """
    if mode == "recursive":
        future = forecast_recursive(model, features if hourly is None else hourly, grid, noise, seed)
    else:
        future = forecast_with_model(model, features, grid, mode)
        if noise:
            future = add_noise(future, features, noise, seed)
    future = add_bounds(future, features, noisy=bool(noise), seed=seed)
    return with_history(future, features).transform(clip_forecast, settings)


# --- summaries -------------------------------------------------------------


def forecast_summary(future: DataFrame) -> DataFrame:
    v = "predicted_glucose"
    return future.groupBy("patient_id").agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("from_time"),
        F.max("timestamp").alias("to_time"),
        F.avg(v).alias("mean_predicted"),
        F.min(v).alias("min_predicted"),
        F.max(v).alias("max_predicted"),
        F.stddev_samp(v).alias("std_predicted"),
    )


def forecast_status(summary: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Plain-word status of the mean, the lowest and the highest prediction."""
    mean, low, high = F.col("mean_predicted"), settings.range_low, settings.range_high
    return summary.withColumns(
        {
            "status": F.when(mean.between(low, high), "Healthy")
            .when(mean < low, "Low")
            .when(mean.isNotNull(), "High"),
            "low_risk": F.when(F.col("min_predicted") < low, "Low Risk").otherwise("Safe"),
            "high_risk": F.when(F.col("max_predicted") > high, "High Risk").otherwise("Safe"),
        }
    )
