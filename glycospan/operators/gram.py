"""Linear models from sufficient statistics that can be merged.

Counts, sums and products of inputs and target are JVM aggregates, combined before the
shuffle. Statistics of days, of patients or of earlier runs are merged by adding them, so a
refit after new data needs the old statistics and the new rows only. What is solved is one
small system for each patient, or one for all.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TARGET = "glucose"
#: Taken from glucose levels before they are multiplied: sums of squares stay near the variances.
LEVEL = 120.0
#: Shares of a sum of squares below which a variance, and of the largest direction below which a
#: direction of the inputs, is rounding.
LEAST_VARIANCE, LEAST_DIRECTION = 1e-12, 1e-10


def _shift(column: str) -> float:
    level = column == TARGET or column.startswith(("glucose_lag_", "glucose_rolling_mean"))
    return LEVEL if level else 0.0


def statistics(rows: DataFrame, columns: list[str], by: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Products of 1, the inputs and the target with each other, summed for each group.

    Row ``i`` of a group has the array ``products`` of value i with all of them; those of 0 are
    the count and the sums. Rows without target or with a missing input are left out.
    """
    names = [*columns, TARGET]
    # nulls go before the columns are renamed: behind that, constraints of all renamings would be inferred
    whole = rows.na.drop("any", subset=names)
    values = F.array(F.lit(1.0), *[F.col(c).cast("double") - F.lit(_shift(c)) for c in names])
    each = whole.select(*by, values.alias("v")).select(*by, "v", F.posexplode("v").alias("i", "a"))
    sums = F.array(*[F.sum(F.col("a") * F.col("v")[j]) for j in range(len(names) + 1)])
    return each.groupBy(*by, "i").agg(sums.alias("products"))


def merged(*tables: DataFrame, size: int, by: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Statistics of ``size`` inputs over the rows of all ``tables``, of coarser groups if ``by`` names fewer columns."""
    rows = reduce(DataFrame.unionByName, (t.select(*by, "i", "products") for t in tables))
    return rows.groupBy(*by, "i").agg(F.array(*[F.sum(F.col("products")[j]) for j in range(size + 2)]).alias("products"))


def _matrices(table: DataFrame) -> DataFrame:
    """One row for each patient: its products in one array, row by row."""
    rows = F.array_sort(F.collect_list(F.struct("i", "products")))
    return table.groupBy("patient_id").agg(F.flatten(F.transform(rows, lambda r: r["products"])).alias("m"))


def _system(row: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(count, means, deviations, correlations of the inputs, mean products of scaled inputs and centred target)."""
    k = int(round(len(row) ** 0.5))
    matrix = np.asarray(row, float).reshape(k, k)
    n = matrix[0, 0]
    means, products = matrix[0, 1:] / n, matrix[1:, 1:] / n
    cov = products - np.outer(means, means)
    variance = np.diag(cov).copy()
    variance[variance <= LEAST_VARIANCE * np.maximum(np.diag(products), 1e-300)] = 0.0
    spread = np.where(variance > 0, np.sqrt(variance), 1.0)
    alive = np.where(variance > 0, 1.0, 0.0)
    z = cov * np.outer(alive, alive) / np.outer(spread, spread)
    return n, means, spread, z[:-1, :-1], z[:-1, -1] * spread[-1]


def solve(name: str, gram: np.ndarray, moment: np.ndarray, n: float, params: dict, lasso) -> tuple[np.ndarray, bool]:
    """Weights of scaled inputs from their correlations and their mean products with the centred target.

    Without a penalty, dependent inputs get the solution of least norm.
    """
    if name == "lasso":
        return lasso(gram, moment, params["alpha"])
    penalty = params["alpha"] / n if name == "ridge" else 0.0
    values, directions = np.linalg.eigh(gram)
    values = values + penalty
    kept = values > LEAST_DIRECTION * max(values.max(initial=0.0), 1e-300)
    return directions[:, kept] @ ((directions[:, kept].T @ moment) / values[kept]), True


def patient_coefficients(name: str, table: DataFrame, columns: list[str], params: dict, lasso) -> DataFrame:
    """A row of coefficients on the unscaled inputs for each row of ``table``, which has statistics by patient."""
    shifts = np.array([_shift(c) for c in [*columns, TARGET]])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for patient, row in zip(pdf["patient_id"], pdf["m"], strict=True):
                n, coef, intercept, converged, failure = 0, None, None, False, None
                try:
                    n, means, spread, gram, moment = _system(row)
                    weights, converged = solve(name, gram, moment, n, params, lasso)
                    coef = weights / spread[:-1]
                    means = means + shifts
                    intercept = float(means[-1] - means[:-1] @ coef)
                except (ArithmeticError, ValueError, np.linalg.LinAlgError) as problem:
                    failure = str(problem)
                out.append((patient, coef, intercept, int(n), converged, failure))
            yield pd.DataFrame(out, columns=["patient_id", "coef", "intercept", "n", "converged", "failure"])

    return _matrices(table).mapInPandas(
        fit, "patient_id long, coef array<double>, intercept double, n long, converged boolean, failure string"
    )


def scales(table: DataFrame, columns: list[str]) -> DataFrame:
    """The patients' means and deviations of the inputs (1 where there is none), and the mean of the target."""
    shifts = np.array([_shift(c) for c in [*columns, TARGET]])
    out = ["patient_id", "level", *[f"{c}__mean" for c in columns], *[f"{c}__std" for c in columns]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for patient, row in zip(pdf["patient_id"], pdf["m"], strict=True):
                _, means, spread, _, _ = _system(row)
                means = means + shifts
                rows.append((patient, means[-1], *means[:-1], *spread[:-1]))
            yield pd.DataFrame(rows, columns=out)

    return _matrices(table).mapInPandas(run, ", ".join(f"`{c}` {'long' if c == 'patient_id' else 'double'}" for c in out))


def pooled_system(table: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean products of the scaled inputs, and with the centred target) over all patients.

    Each patient's inputs are scaled by its own statistics, so the pooled products are sums of
    the patients' correlations, weighed by their rows. Tasks add up their patients, Spark adds
    the tasks; a number for each pair of inputs reaches the driver.
    """
    k = len(columns) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for pdf in batches:
            for row in pdf["m"]:
                n, _, _, gram, moment = _system(row)
                total[: k - 1, : k - 1] += n * gram
                total[: k - 1, k - 1] += n * moment
                total[k - 1, k - 1] += n
        yield pd.DataFrame({"place": np.arange(k * k), "v": total.ravel()})

    sums = _matrices(table).select("m").mapInPandas(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(k * k)
    total[sums["place"]] = sums["v"]
    total = total.reshape(k, k)
    n = int(total[-1, -1])
    if not n:
        raise ValueError("no complete training rows")
    return n, total[:-1, :-1] / n, total[:-1, -1] / n
