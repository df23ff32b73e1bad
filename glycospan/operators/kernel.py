"""Exact support vector regression with an RBF kernel, one fit per patient.

The dual of the ε-insensitive loss is solved by steps on two variables at a time until its
optimality gap is below a tolerance; kernel rows are made when a step needs them and kept
up to a bound.
"""

from __future__ import annotations

import sys
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycospan.operators.features import input_columns
from glycospan.operators.grouped import add_predictions, group_count
from glycospan.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Optimality gap at which a fit ends, in units of the target, and steps for each row before it gives up.
TOLERANCE, STEPS_PER_ROW = 1e-3, 2_000
#: Bytes of kernel rows that a fit keeps, and kernel values that scoring makes at a time.
CACHE_BYTES, SCORED_TOGETHER = 64 << 20, 4_000_000
#: Training rows of the patients that are scored together.
ROWS_TOGETHER = 50_000


class KernelRows:
    """Rows of exp(-gamma |a - b|^2), the most recent ones kept."""

    def __init__(self, x: np.ndarray, gamma: float, cache_bytes: int = CACHE_BYTES):
        self.x, self.gamma, self.squares = x, gamma, (x * x).sum(axis=1)
        self.most = max(2, cache_bytes // (8 * max(len(x), 1)))
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()

    def __getitem__(self, i: int) -> np.ndarray:
        row = self.kept.get(i)
        if row is None:
            distance = self.squares + self.squares[i] - 2 * (self.x @ self.x[i])
            row = self.kept[i] = np.exp(-self.gamma * np.maximum(distance, 0.0))
            row[i] = 1.0
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        else:
            self.kept.move_to_end(i)
        return row


@dataclass
class Fit:
    """``beta`` weighs the rows, -c to c, and adds up to 0; ``gap`` is what is left of the optimality conditions."""

    beta: np.ndarray
    intercept: float
    gap: float
    steps: int


def solve(x: np.ndarray, y: np.ndarray, gamma: float, c: float, epsilon: float, tolerance: float = TOLERANCE) -> Fit:
    """Minimise ½ b'Kb - y'b + epsilon |b|_1 with -c <= b <= c and sum b = 0.

    Each step raises the row that most wants to rise and lowers the row that gains most with
    it. ``residual`` is y - Kb. A row may rise at the price of its error band unless it is at c,
    and fall unless it is at -c; at the optimum no rise is worth more than a fall.
    """
    n = len(y)
    kernel, beta, residual = KernelRows(x, gamma), np.zeros(n), y.astype(float).copy()
    steps, gap, middle = 0, 0.0, float(y.mean()) if n else 0.0
    while n:
        rise = np.where(beta >= c, -np.inf, np.where(beta < 0, residual + epsilon, residual - epsilon))
        fall = np.where(beta <= -c, np.inf, np.where(beta > 0, residual - epsilon, residual + epsilon))
        i = int(np.argmax(rise))
        gap, middle = float(rise[i] - fall.min()), float(rise[i] + fall.min()) / 2
        if gap <= tolerance or steps >= STEPS_PER_ROW * n:
            break
        row = kernel[i]
        curve = np.maximum(2.0 - 2.0 * row, 1e-12)
        worth = rise[i] - fall
        j = int(np.argmax(np.where(worth > 0, worth * worth / curve, -np.inf)))
        # the step ends where a weight reaches its bound, or 0, behind which the band has another sign
        room_up = -beta[i] if beta[i] < 0 else c - beta[i]
        room_down = beta[j] if beta[j] > 0 else c + beta[j]
        step = min(worth[j] / curve[j], room_up, room_down)
        beta[i] = _snapped(beta[i] + step, c)
        beta[j] = _snapped(beta[j] - step, c)
        residual -= step * (row - kernel[j])
        steps += 1
    return Fit(beta, middle, max(gap, 0.0), steps)


def _snapped(b: float, c: float) -> float:
    """Weights that rounding leaves next to 0 or a bound are put there."""
    for at in (0.0, c, -c):
        if abs(b - at) < 1e-12 * max(c, 1.0):
            return at
    return b


_FIELDS = "patient_id long, points array<double>, beta array<double>, intercept double, gamma double, centre array<double>, spread array<double>, n long, gap double, steps long, failure string"


@dataclass(frozen=True)
class PatientKernelModel:
    """Support vectors of each patient, with the gap and the steps of its fit."""

    algorithm: str
    fits: DataFrame
    columns: list[str]
    tasks: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """Null for patients without a fit and for rows with a missing input."""
        return add_predictions(rows, self.fits, self.columns, score_with, self.tasks)

    def stepper(self) -> tuple[DataFrame, Callable]:
        """See forecasting.forecast_recursive."""
        return self.fits, score_with


def score_with(fits: pd.DataFrame, who: pd.Index) -> tuple[np.ndarray, Callable]:
    """See grouped.Build."""
    known, parts = np.zeros(len(who), bool), {}
    for r in fits[fits["patient_id"].isin(who) & fits["intercept"].notna()].itertuples():
        p = who.get_loc(r.patient_id)
        beta, spread = np.asarray(r.beta, float), np.asarray(r.spread, float)
        points = np.asarray(r.points, float).reshape(len(beta), -1)
        known[p], parts[p] = True, (points, beta, r.intercept, r.gamma, np.asarray(r.centre, float), spread)

    def values(x: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        order = np.argsort(place, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            points, beta, intercept, gamma, centre, spread = parts[place[rows[0]]]
            z, own = (x[rows] - centre) / spread, (points * points).sum(axis=1)
            step = max(1, SCORED_TOGETHER // max(len(beta), 1))
            for at in range(0, len(rows), step):
                part = z[at : at + step]
                distance = (part * part).sum(axis=1)[:, None] + own - 2 * (part @ points.T)
                out[rows[at : at + step]] = np.exp(-gamma * np.maximum(distance, 0.0)) @ beta + intercept
        return out

    return known, values


def fit_patient_kernels(name: str, train: DataFrame, params: dict) -> PatientKernelModel:
    """Support vector regression of every patient on inputs that are scaled by its own rows.

    ``gamma`` is 1 / (inputs x variance of all scaled values) unless given. Rows without target
    or with a missing input are left out. A fit that can't be made has a null intercept and says why.
    """
    columns = input_columns(train)
    c, epsilon, tolerance = params["c"], params["epsilon"], params.get("tolerance", TOLERANCE)
    rows = train.select(F.col("patient_id").cast("long"), "hour_ts", F.col("glucose").cast("double"), *[F.col(k).cast("double") for k in columns]).na.drop("any")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hour_ts", "glucose", *columns])
        x, y = pdf[columns].to_numpy(float), pdf["glucose"].to_numpy(float)
        centre, spread = x.mean(axis=0), x.std(axis=0)
        spread = np.where(spread == 0, 1.0, spread)
        z = (x - centre) / spread
        out = {"patient_id": pdf["patient_id"].iloc[0], "centre": centre, "spread": spread, "n": len(y), "failure": None}
        try:
            variance = z.var() if z.size else 0.0
            gamma = params.get("gamma") or (1.0 / (z.shape[1] * variance) if variance else 1.0)
            found = solve(z, y, gamma, c, epsilon, tolerance)
            used = found.beta != 0
            out |= {"points": z[used].ravel(), "beta": found.beta[used], "intercept": found.intercept, "gamma": gamma, "gap": found.gap, "steps": found.steps}
        except (ArithmeticError, ValueError, MemoryError) as problem:
            out |= {"points": None, "beta": None, "intercept": None, "gamma": None, "gap": None, "steps": None, "failure": str(problem)}
        return pd.DataFrame([out])[[f.split()[0] for f in _FIELDS.split(", ")]]

    fits = durable(rows.groupBy("patient_id").applyInPandas(fit, _FIELDS))
    return PatientKernelModel(name, fits, columns, group_count(rows, rows.count(), ROWS_TOGETHER))
