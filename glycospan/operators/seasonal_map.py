"""Seasonal forecaster fitted as a posterior mode, with trend changes that are mostly zero.

The trend is piecewise linear; its changes have a Laplace prior, so most of them vanish. The
seasonal terms multiply it. Trend, season and noise level are found in turns, each exactly,
until the posterior stands still. Bounds come from drawn futures in which the trend goes on
changing as often and as much as it did, so they widen with the horizon.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glycospan.functions.numeric import nan_to_null
from glycospan.operators.seasonal import (
    CHANGEPOINT_PRIOR,
    CHANGEPOINT_SPAN,
    CHANGEPOINTS,
    DAILY_ORDER,
    SEASONALITY_PRIOR,
    WEEKLY_ORDER,
    FourierTrend,
    _fourier,
    _hinges,
)
from glycospan.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Deviations of the priors of level and slope, and of the noise; order of the
# plain daily term, which overlaps with the finer one; share of the drawn futures in the bounds.
LINE_PRIOR, NOISE_PRIOR, PLAIN_DAILY_ORDER, INTERVAL = 5.0, 0.5, 4, 0.95
#: The fit ends when a round lowers the objective by no more than this share of it.
TOLERANCE, ROUNDS = 1e-10, 1_000
DRAWS = 1_000
#: Rows of a patient whose futures are drawn at a time.
DRAWN_ROWS = 256
_LEAST_VARIANCE = 1e-10


def lasso_exactly(gram: np.ndarray, moment: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minimise w'Gw/2 - m'w + sum weight |w| for a positive definite G, by its active signs.

    Inputs with weight 0 are free. From ``start``, signs are added where the gradient asks for
    it, and lost where the solution for given signs would cross zero; each step lowers the
    objective, and there are finitely many signs.
    """
    w, free = start.copy(), weight == 0

    def cost(v: np.ndarray) -> float:
        return float(v @ gram @ v / 2 - moment @ v + weight @ np.abs(v))

    for _ in range(200 * len(w)):
        slope = gram @ w - moment
        sign = np.sign(w)
        active = free | (sign != 0)
        broken = np.abs(slope + weight * sign)[active].max(initial=0.0)
        if broken <= 1e-10 * max(1.0, np.abs(moment).max()):
            excess = np.where(active, -np.inf, np.abs(slope) - weight)
            j = int(np.argmax(excess))
            if excess[j] <= 1e-10 * max(1.0, np.abs(moment).max()):
                return w
            sign[j], active[j] = -np.sign(slope[j]), True
        target = np.zeros_like(w)
        target[active] = np.linalg.solve(gram[np.ix_(active, active)], (moment - weight * sign)[active])
        # the best of the solution and the points on the way where a weight becomes zero
        crossing = np.flatnonzero(~free & (w != 0) & (np.sign(target) != np.sign(w)))
        stops = [target] + [np.where(np.arange(len(w)) == k, 0.0, w + (target - w) * (w[k] / (w[k] - target[k]))) for k in crossing]
        wrong = ~free & (w == 0) & (np.sign(target) != 0) & (np.sign(target) != sign)
        if wrong.any():
            stops[0] = np.where(wrong, 0.0, target)
        best = min(stops, key=cost)
        if cost(best) >= cost(w) - 1e-15 * max(1.0, abs(cost(w))):
            return w
        w = best
    return w


@dataclass
class MapFit:
    trend: np.ndarray
    season: np.ndarray
    variance: float
    objective: float
    rounds: int
    converged: bool


def season_precision() -> np.ndarray:
    """Prior precision of the seasonal terms; a wave that two terms hold has both their variances."""
    twice = [k <= PLAIN_DAILY_ORDER for k in range(1, DAILY_ORDER + 1)] + [False] * WEEKLY_ORDER
    once = 1.0 / SEASONALITY_PRIOR**2
    return np.tile(np.where(twice, once / 2, once), 2)


def objective(y, design, waves, trend, season, variance: float) -> float:
    """Minus the logarithm of the posterior, up to a constant. ``trend`` is level, slope and changes."""
    error = y - (design @ trend) * (1 + waves @ season)
    line = (trend[:2] ** 2).sum() / (2 * LINE_PRIOR**2) + np.abs(trend[2:]).sum() / CHANGEPOINT_PRIOR
    return float(error @ error / (2 * variance) + len(y) * np.log(variance) / 2 + line + (season_precision() * season**2).sum() / 2 + variance / (2 * NOISE_PRIOR**2))


def fit_mode(y: np.ndarray, design: np.ndarray, waves: np.ndarray) -> MapFit:
    """The mode of the posterior by exact steps in trend, season and noise."""
    trend, season = np.zeros(design.shape[1]), np.zeros(waves.shape[1])
    trend[0] = y.mean()
    variance = max(float(y.var()), _LEAST_VARIANCE)
    ridge = np.r_[np.full(2, 1 / LINE_PRIOR**2), np.zeros(design.shape[1] - 2)]
    weight = np.r_[0.0, 0.0, np.full(design.shape[1] - 2, 1 / CHANGEPOINT_PRIOR)]
    now, converged, rounds = objective(y, design, waves, trend, season, variance), False, 0
    while rounds < ROUNDS and not converged:
        rounds += 1
        line = design @ trend
        product = waves * line[:, None]
        season = np.linalg.solve(product.T @ product / variance + np.diag(season_precision()), product.T @ (y - line) / variance)
        scaled = design * (1 + waves @ season)[:, None]
        gram = scaled.T @ scaled / variance + np.diag(ridge) + 1e-10 * np.eye(len(trend))
        trend = lasso_exactly(gram, scaled.T @ y / variance, weight, trend)
        error = y - (design @ trend) * (1 + waves @ season)
        squares = float(error @ error)
        # root of n / s - RSS / s^3 + s / prior^2, in s^2
        n, p = len(y), 1 / NOISE_PRIOR**2
        variance = max(2 * squares / (n + np.sqrt(n * n + 4 * p * squares)), _LEAST_VARIANCE)
        before, now = now, objective(y, design, waves, trend, season, variance)
        converged = before - now <= TOLERANCE * max(1.0, abs(now))
    return MapFit(trend, season, variance, now, rounds, converged)


_FIELDS = (
    "patient_id long, first_hour double, span_hours double, scale double, trend_coef array<double>, season_coef array<double>, "
    "sigma double, change_chance double, change_size double, rounds int, converged boolean"
)


def _fit_patient(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.dropna(subset=["glucose"]).sort_values("hour_ts")
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    if pdf.empty:
        return pd.DataFrame(columns=names)
    hours = pdf["hour_ts"].to_numpy().astype("datetime64[s]").astype("int64") / 3600.0
    y = pdf["glucose"].to_numpy(dtype=float)
    span, scale = max(hours[-1] - hours[0], 1.0), max(np.abs(y).max(), 1e-9)
    knots = np.linspace(0, CHANGEPOINT_SPAN, CHANGEPOINTS + 2)[1:-1]
    found = fit_mode(y / scale, _hinges((hours - hours[0]) / span, knots), _fourier(hours))
    row = {
        "patient_id": pdf["patient_id"].iloc[0],
        "first_hour": hours[0],
        "span_hours": span,
        "scale": scale,
        "trend_coef": found.trend,
        "season_coef": found.season,
        "sigma": float(np.sqrt(found.variance)) * scale,
        # changes of the slope: how likely one is in an hour, and their mean size in glucose per hour
        "change_chance": CHANGEPOINTS / span,
        "change_size": float(np.abs(found.trend[2:]).mean()) * scale / span,
        "rounds": found.rounds,
        "converged": found.converged,
    }
    return pd.DataFrame([row])[names]


def _uniforms(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """``numeric.uniform`` of the keys that a head (row) and a tail (column) make together."""
    digests = b"".join([md5(h + t).digest()[:8] for h in heads for t in tails])
    bits = np.frombuffer(digests, ">u8").reshape(len(heads), len(tails)) >> np.uint64(12)
    return (bits.astype(float) + 0.5) / float(2**52)


def _drawn_quantiles(pdf: pd.DataFrame, draws: int, seed: int, interval: float) -> pd.DataFrame:
    """Bounds of the rows of one patient, in order of time."""
    patient = pdf["patient_id"].iloc[0]
    chance, size, sigma = pdf[["change_chance", "change_size", "sigma"]].iloc[0].astype(float)
    micros = pdf["micros"].to_numpy(np.int64)
    hour = micros / 3.6e9
    at = hour - hour[0]
    stretch = np.r_[1.0, np.diff(at)]
    trend, season = pdf["trend"].to_numpy(float)[:, None], pdf["season"].to_numpy(float)[:, None]
    tails = {key: [f"{d}|{seed}|{key[0]}|{key[1]}".encode() for d in range(1, draws + 1)] for key in ((5, 1), (6, 1), (7, 1), (7, 2))}
    change_sum, moment_sum = np.zeros(draws), np.zeros(draws)
    found = np.empty((len(pdf), 2))
    for first in range(0, len(pdf), DRAWN_ROWS):
        part = slice(first, first + DRAWN_ROWS)
        heads = [f"{patient}|{m}|".encode() for m in micros[part].tolist()]
        change = np.zeros((len(heads), draws))
        i, j = np.nonzero(_uniforms(heads, tails[5, 1]) < chance * stretch[part, None])
        side = np.array([_uniforms([heads[r]], [tails[6, 1][c]])[0, 0] for r, c in zip(i, j, strict=True)]) - 0.5
        change[i, j] = -size * np.sign(side) * np.log(1.0 - 2.0 * np.abs(side))
        changes = change_sum + np.cumsum(change, axis=0)
        moments = moment_sum + np.cumsum(change * at[part, None], axis=0)
        change_sum, moment_sum = changes[-1], moments[-1]
        normal = np.sqrt(-2.0 * np.log(_uniforms(heads, tails[7, 1]))) * np.cos(2.0 * np.pi * _uniforms(heads, tails[7, 2]))
        value = (trend[part] + at[part, None] * changes - moments) * season[part] + sigma * normal
        found[part] = np.quantile(value, [(1 - interval) / 2, (1 + interval) / 2], axis=1).T
    return pd.DataFrame({"patient_id": patient, "micros": micros, "lower_bound": found[:, 0], "upper_bound": found[:, 1]})


def drawn_bounds(
    rows: DataFrame, changes: DataFrame, draws: int = DRAWS, seed: int = 0, interval: float = INTERVAL, ts: str = "timestamp"
) -> DataFrame:
    """``rows`` with ``lower_bound`` and ``upper_bound``: quantiles of drawn futures.

    ``rows`` are future rows with patient, time, ``trend`` and ``season``, the factor on the
    trend; ``changes`` has change_chance (per hour), change_size and sigma of each patient. In a
    draw, a row's stretch of time since the row before changes the slope with the chance of its
    hours, by a Laplace draw; what is added to the trend grows from there. All draws hang on
    patient, time, draw and seed alone. A patient's rows go to one task once, which draws for a
    stretch of rows at a time; no row is made for a draw.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism) + 1
    each = (
        rows.select("patient_id", F.unix_micros(ts).alias("micros"), F.col("trend").cast("double"), F.col("season").cast("double"))
        .join(changes.select("patient_id", "change_chance", "change_size", "sigma"), "patient_id")
        .repartition(tasks, "patient_id")  # not the number of the join's parts, which are merged where rows are few
    )

    def quantiles(pdf: pd.DataFrame) -> pd.DataFrame:
        return _drawn_quantiles(pdf.sort_values("micros"), draws, seed, interval)

    bounds = (
        each.groupBy("patient_id")
        .applyInPandas(quantiles, "patient_id long, micros long, lower_bound double, upper_bound double")
        .select(
            "patient_id",
            F.timestamp_micros("micros").alias(ts),
            nan_to_null(F.col("lower_bound")).alias("lower_bound"),
            nan_to_null(F.col("upper_bound")).alias("upper_bound"),
        )
    )
    return rows.drop("lower_bound", "upper_bound").join(bounds, ["patient_id", ts], "left")


class MapTrend(FourierTrend):
    """Coefficients of the mode, one row per patient; scoring is a column expression."""

    def with_drawn_bounds(self, rows: DataFrame, ts: str = "timestamp", draws: int = DRAWS, seed: int = 0) -> DataFrame:
        """Scored rows, of which those of ``is_future`` get bounds from drawn futures."""
        season: Column = F.coalesce(F.try_divide("predicted_glucose", "trend"), F.lit(1.0))
        ahead = rows.where("is_future").withColumn("season", season)
        drawn = drawn_bounds(ahead, self.coefficients, draws, seed, ts=ts).select(*rows.columns)
        return rows.where(~F.col("is_future")).unionByName(drawn)


def fit_map_trend(history: DataFrame) -> MapTrend:
    """One small fit per patient, over at most one row per hour of calendar time.

    Rows without a value are left out; a patient without values has no model. ``rounds`` and
    ``converged`` tell how the fit ended.
    """
    fitted = history.select(F.col("patient_id").cast("long"), "hour_ts", "glucose").groupBy("patient_id").applyInPandas(_fit_patient, _FIELDS)
    return MapTrend(durable(fitted))
