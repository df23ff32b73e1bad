"""Calendar, lag and rolling features of the hourly grid.

All windows share one specification (patient, ordered by hour), so Spark sorts the
grid once. A patient has at most one row per hour of calendar time here.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from glycospan.config import DIFFS, LAGS, WINDOWS
from glycospan.functions.calendar import is_weekend, weekday

TARGET_COLUMNS = ("glucose", "glucose_std", "glucose_min", "glucose_max", "reading_count")
CALENDAR = ("hour", "day_of_week", "day_of_month", "month")
KEYS = ("patient_id", "hour_ts")


def _in_order() -> WindowSpec:
    return Window.partitionBy("patient_id").orderBy("hour_ts")


def calendar_columns(ts: str = "hour_ts") -> dict[str, Column]:
    t = F.col(ts)
    return {
        "hour": F.hour(t),
        "day_of_week": weekday(t),
        "day_of_month": F.dayofmonth(t),
        "month": F.month(t),
    }


def add_calendar(hourly: DataFrame, weekend: bool = False) -> DataFrame:
    columns = calendar_columns()
    if weekend:
        columns["is_weekend"] = is_weekend(F.col("hour_ts"))
    return hourly.withColumns(columns)


def add_lags(hourly: DataFrame, lags=LAGS) -> DataFrame:
    return hourly.withColumns(
        {f"glucose_lag_{k}h": F.lag("glucose", k).over(_in_order()) for k in lags}
    )


def add_rolling(hourly: DataFrame, windows=WINDOWS) -> DataFrame:
    """Mean and deviation of complete windows; null while a value is missing.

    A window that is a multiple of a shorter one is put together from the moments
    of the shorter windows before it, so only the shortest frame visits its rows
    one by one. Moments are merged around their means, which loses no precision.
    """
    order = _in_order()
    df, done = hourly, []
    for n in sorted(windows):
        mean, squares = f"mean__{n}", f"squares__{n}"
        parts = [p for p in done if n % p == 0]
        if not parts:
            frame = order.rowsBetween(1 - n, 0)
            complete = F.count("glucose").over(frame) == n
            df = df.withColumns(
                {
                    mean: F.when(complete, F.avg("glucose").over(frame)),
                    squares: F.when(complete, F.var_pop("glucose").over(frame) * n),
                }
            )
        else:
            size = parts[-1]
            pieces = range(0, n, size)
            names = {k: (f"m__{k}", f"s__{k}") for k in pieces}
            df = df.withColumns(
                {m: F.lag(f"mean__{size}", k).over(order) for k, (m, _) in names.items()}
                | {q: F.lag(f"squares__{size}", k).over(order) for k, (_, q) in names.items()}
            )
            df = df.withColumn(
                mean, reduce(operator.add, [F.col(m) for m, _ in names.values()]) / len(names)
            )
            between = [(F.col(m) - F.col(mean)) * (F.col(m) - F.col(mean)) for m, _ in names.values()]
            df = df.withColumn(
                squares,
                reduce(operator.add, [F.col(q) for _, q in names.values()])
                + reduce(operator.add, between) * size,
            ).drop(*[c for pair in names.values() for c in pair])
        done.append(n)
    columns = {}
    for n in windows:
        columns[f"glucose_rolling_mean_{n}h"] = F.col(f"mean__{n}")
        columns[f"glucose_rolling_std_{n}h"] = F.sqrt(F.try_divide(F.col(f"squares__{n}"), F.lit(n - 1)))
    return df.withColumns(columns).select(*hourly.columns, *columns)


def add_expanding_rolling(hourly: DataFrame, size: int = 24) -> DataFrame:
    """Rolling mean and deviation that start with the first row."""
    frame = _in_order().rowsBetween(1 - size, 0)
    return hourly.withColumns(
        {
            "glucose_rolling_mean": F.avg("glucose").over(frame),
            "glucose_rolling_std": F.stddev_samp("glucose").over(frame),
        }
    )


def add_differences(hourly: DataFrame, diffs=DIFFS) -> DataFrame:
    return hourly.withColumns(
        {
            f"glucose_diff_{k}h": F.col("glucose") - F.lag("glucose", k).over(_in_order())
            for k in diffs
        }
    )


def build_features(hourly: DataFrame, leak_free: bool = False, drop_incomplete: bool = True) -> DataFrame:
    """The full feature table.

    ``glucose_lag_1h + glucose_diff_1h`` is the target itself, and the rolling
    columns include it. ``leak_free`` moves the rolling and difference columns one
    row back, which is what can be known when the row is to be predicted.
    """
    table = hourly.transform(add_calendar).transform(add_lags)
    table = table.transform(add_rolling).transform(add_differences)
    if leak_free:
        table = table.withColumns(
            {
                c: F.lag(c, 1).over(_in_order())
                for c in table.columns
                if c.startswith(("glucose_rolling_", "glucose_diff_"))
            }
        )
    return table.na.drop("any") if drop_incomplete else table


def simple_features(hourly: DataFrame) -> DataFrame:
    """The small feature set whose rolling state a forecast can continue."""
    return (
        hourly.select(*KEYS, "glucose")
        .transform(add_calendar, True)
        .transform(add_expanding_rolling)
    )


def input_columns(features: DataFrame) -> list[str]:
    """Model inputs: everything but the keys and the columns of the current hour."""
    return [c for c in features.columns if c not in KEYS + TARGET_COLUMNS]


def standard_scale(df: DataFrame, columns: list[str], by: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Centre and divide by the population deviation; constant columns by 1."""
    group = Window.partitionBy(*by)

    def scaled(c: str) -> Column:
        std = F.stddev_pop(c).over(group)
        return (F.col(c) - F.avg(c).over(group)) / F.when(std == 0, F.lit(1.0)).otherwise(std)

    return df.withColumns({c: scaled(c) for c in columns})
