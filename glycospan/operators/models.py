"""Regressors over the feature table.

Inputs are scaled and the target is centred per patient with statistics of the
training rows, so one pooled fit serves patients of different levels. Fitted per
patient, they are the counterparts of training on one patient alone.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import regression as ml
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glycospan.operators import boosting, forest, gram, kernel, trees
from glycospan.operators.features import input_columns
from glycospan.operators.neighbours import predict_neighbours
from glycospan.operators.seasonal import fit_fourier_trend, fit_seasonal_trend
from glycospan.operators.seasonal_map import fit_map_trend
from glycospan.session import durable, durable_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The ten algorithm names.
ALGORITHMS = (
    "prophet",
    "linear_regression",
    "ridge",
    "lasso",
    "random_forest",
    "gradient_boosting",
    "xgboost",
    "svr",
    "knn",
    "decision_tree",
)
LINEAR = ("linear_regression", "ridge", "lasso")
TREES = ("random_forest", "gradient_boosting", "xgboost", "decision_tree")

# Default hyper-parameters.
DEFAULT_PARAMS = {
    "prophet": {"method": "index"},
    "linear_regression": {},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 1.0},
    "random_forest": {"trees": 100, "depth": 20, "min_split": 5, "min_leaf": 2, "seed": 42},
    "gradient_boosting": {"iterations": 100, "depth": 5, "rate": 0.1, "seed": 42},
    "xgboost": {"iterations": 100, "depth": 5, "rate": 0.1, "penalty": 1.0, "least_gain": 0.0, "least_weight": 1.0},
    "svr": {"c": 1.0, "epsilon": 0.1, "waves": 128, "seed": 42},
    "knn": {"k": 5},
    "decision_tree": {"depth": 10, "min_split": 5, "seed": 42},
}

#: Methods of ``prophet``: index of the hour of week, ridge Fourier terms, or posterior mode.
SEASONAL_FITS = {"index": fit_seasonal_trend, "fourier": fit_fourier_trend, "map": fit_map_trend}

#: Training rows of a pooled fit are laid out by hash of patient and hour, sorted inside
#: partitions whose number follows from the number of rows alone: bagging and split sampling
#: are seeded per partition, so a fit is the same on any cluster (or parameter ``partitions``).
FIT_PARTITIONS, ROWS_PER_PARTITION = 8, 250_000


def fit_partitions(n: int) -> int:
    return max(FIT_PARTITIONS, -(-n // ROWS_PER_PARTITION))


def tree_memory_mb(spark: SparkSession) -> int:
    """MB of split statistics that Spark's tree learners keep per pass: 1/32 of the driver's heap.

    It sets how many nodes are split in a job, and does not change the model.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory() >> 20
    return int(min(max(heap // 32, 16), 256))


#: Pooled linear fits stop when neither loss nor gradient moves by this share.
ITERATIVE = {"tol": 1e-10, "maxIter": 2_000}


def check_algorithm(name: str) -> None:
    if name not in DEFAULT_PARAMS:
        raise ValueError(f"unknown algorithm {name!r}; one of {', '.join(ALGORITHMS)}")


# --- scaling ---------------------------------------------------------------


@dataclass(frozen=True)
class Scaler:
    """Per-patient centre and scale of every input and the centre of the target."""

    table: DataFrame
    columns: list[str]

    def apply(self, rows: DataFrame) -> DataFrame:
        """Replace the inputs by their scaled values and add ``level``."""
        scaled = {
            c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in self.columns
        }
        # a patient without training rows keeps its rows: scaled inputs and level are null
        joined = rows.join(self.table, "patient_id", "left")
        return joined.withColumns(scaled).select(*rows.columns, "level")


def fit_scaler(train: DataFrame, columns: list[str]) -> Scaler:
    stats = [F.avg("glucose").alias("level")]
    for c in columns:
        stats.append(F.avg(c).alias(f"{c}__mean"))
        std = F.stddev_pop(c)
        stats.append(F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"{c}__std"))
    return Scaler(train.groupBy("patient_id").agg(*stats), columns)


def _one_row_each(score: Callable) -> Callable:
    """What a recursive forecast needs of models with one row (patient_id, a, b, c) for each patient:
    from a group's rows and its patients, which are known, and a function of their inputs."""

    def build(table: pd.DataFrame, who: pd.Index) -> tuple[np.ndarray, Callable]:
        table = table.set_index("patient_id").reindex(who)
        known = table["c"].notna().to_numpy()
        some = table[known]
        a, b = (np.vstack(some[k].to_numpy()) if len(some) else np.zeros((0, 0)) for k in "ab")
        c, at = some["c"].to_numpy(float), np.cumsum(known) - 1

        def values(x: np.ndarray, place: np.ndarray) -> np.ndarray:
            mine = at[place]
            return score(x, a[mine], b[mine], c[mine]) if len(x) else np.zeros(0)

        return known, values

    return build


# --- pooled Spark ML models ------------------------------------------------


def pooled_nodes(model, spark: SparkSession) -> trees.FlatTrees:
    """The nodes of a fitted Spark ML tree model, read from its saved form."""
    if isinstance(model, trees.FlatTrees):
        return model
    if isinstance(model, forest.PooledForest):
        return model.flat()
    path = durable_path(spark)
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "treeID" not in saved.columns:
        saved = saved.select(F.lit(0).alias("treeID"), F.struct(*saved.columns).alias("nodeData"))
    nodes = saved.select("treeID", "nodeData.*").toPandas().sort_values(["treeID", "id"]).reset_index(drop=True)
    weights = np.asarray(getattr(model, "treeWeights", [1.0]), float)
    starts = nodes.groupby("treeID").size().cumsum().shift(fill_value=0)
    offset = nodes["treeID"].map(starts).to_numpy(np.int64)
    inner = (nodes["leftChild"] >= 0).to_numpy()
    split = nodes["split"].map(lambda r: (r["featureIndex"], r["leftCategoriesOrThreshold"]))
    return trees.FlatTrees(
        roots=starts.to_numpy(np.int64),
        feature=np.array([f if i else -1 for (f, _), i in zip(split, inner, strict=True)], np.int64),
        threshold=np.array([t[0] if i else 0.0 for (_, t), i in zip(split, inner, strict=True)], float),
        left=np.where(inner, nodes["leftChild"].to_numpy(np.int64) + offset, 0),
        right=np.where(inner, nodes["rightChild"].to_numpy(np.int64) + offset, 0),
        value=nodes["prediction"].to_numpy(float) * weights[nodes["treeID"].to_numpy(np.int64)],
        gain=np.where(inner, nodes["gain"].to_numpy(float), 0.0),
    )


def _estimator(name: str, params: dict, n: int):
    if name == "svr":
        return ml.LinearRegression(
            loss="huber", epsilon=1.35, regParam=1.0 / (params["c"] * max(n, 1)), **ITERATIVE
        )
    return ml.DecisionTreeRegressor(
        maxDepth=params["depth"],
        seed=params["seed"],
        maxMemoryInMB=params["memory_mb"],
    )


def _wave_weights(columns: list[str], params: dict) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(params["seed"])
    gamma = 1.0 / len(columns)
    weights = rng.normal(0.0, np.sqrt(2 * gamma), (len(columns), params["waves"]))
    return weights, rng.uniform(0.0, 2 * np.pi, params["waves"])


def _random_waves(columns: list[str], params: dict) -> Callable[[DataFrame], DataFrame]:
    """Random Fourier features of an RBF kernel with gamma = 1 / number of inputs.

    A linear fit on them approximates the kernel machine and stays distributed.
    """
    weights, phases = _wave_weights(columns, params)
    count = len(phases)

    def waves(values: pd.Series) -> pd.Series:
        x = np.vstack(values.to_numpy())
        return pd.Series(list(np.sqrt(2.0 / count) * np.cos(x @ weights + phases)))

    as_waves = F.pandas_udf(waves, T.ArrayType(T.DoubleType()))

    def transform(df: DataFrame) -> DataFrame:
        inputs = F.array(*[F.col(c).cast("double") for c in columns])
        return df.withColumn("features", array_to_vector(as_waves(inputs)))

    return transform


@dataclass(frozen=True)
class PooledModel:
    algorithm: str
    scaler: Scaler
    vectorise: Callable[[DataFrame], DataFrame]
    model: object
    params: dict = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.scaler.columns

    def stepper(self) -> tuple[DataFrame, Callable]:
        """See forecasting.forecast_recursive."""
        means = F.array(*[F.col(f"{c}__mean") for c in self.columns])
        stds = F.array(*[F.col(f"{c}__std") for c in self.columns])
        table = self.scaler.table.select("patient_id", means.alias("a"), stds.alias("b"), F.col("level").alias("c"))
        if self.algorithm in TREES:
            flat = pooled_nodes(self.model, self.scaler.table.sparkSession)
            return table, _one_row_each(lambda x, a, b, c: flat.values((x - a) / b) + c)
        if self.algorithm in LINEAR:
            line = self.model.weights
            return table, _one_row_each(lambda x, a, b, c: (x - a) / b @ line + c)
        coef, intercept = self.model.coefficients.toArray(), float(self.model.intercept)
        weights, phases = _wave_weights(self.columns, self.params)
        size = np.sqrt(2.0 / len(phases))
        return table, _one_row_each(
            lambda x, a, b, c: size * np.cos((x - a) / b @ weights + phases) @ coef + intercept + c
        )

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows that cannot be scored (no training rows, a missing input) get null."""
        inputs = self.scaler.columns
        ready = self.scaler.apply(rows)
        known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in inputs), F.col("level").isNotNull())
        ready = ready.withColumn("scorable", known).withColumns(
            {c: F.coalesce(F.col(c), F.lit(0.0)) for c in inputs}
        )
        if hasattr(self.model, "add_prediction"):
            scored = self.model.add_prediction(ready, inputs)
        else:
            scored = self.model.transform(self.vectorise(ready))
        value = F.when(F.col("scorable"), F.col("prediction") + F.col("level"))
        return scored.withColumn("prediction", value).select(*rows.columns, "prediction")

    def importances(self, top: int | None = 5) -> DataFrame:
        """Inputs by falling importance (tree models)."""
        if self.algorithm not in TREES:
            raise ValueError(f"{self.algorithm} has no feature importances")
        if isinstance(self.model, (trees.FlatTrees, forest.PooledForest)):
            values = self.model.shares(len(self.columns))
        else:
            values = self.model.featureImportances.toArray().tolist()
        spark = self.scaler.table.sparkSession
        table = spark.createDataFrame(
            list(zip(self.scaler.columns, values)), "feature string, importance double"
        ).orderBy(F.desc("importance"), "feature")
        return table if top is None else table.limit(top)


@dataclass(frozen=True)
class PooledWeights:
    """Weights of the scaled inputs, for the centred target."""

    weights: np.ndarray
    converged: bool

    def add_prediction(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        terms = [F.col(c) * F.lit(float(w)) for c, w in zip(columns, self.weights, strict=True)]
        return rows.withColumn("prediction", reduce(lambda a, b: a + b, terms, F.lit(0.0)))


def _fit_pooled_line(name: str, train: DataFrame, columns: list[str], params: dict) -> PooledModel:
    """The exact solution from the patients' statistics, which also give the scales."""
    table = durable(gram.statistics(train, columns))
    n, products, moment = gram.pooled_system(table, columns)
    weights, converged = gram.solve(name, products, moment, n, params, _lasso)
    return PooledModel(name, Scaler(durable(gram.scales(table, columns)), columns), lambda df: df, PooledWeights(weights, converged), params)


def fit_pooled(name: str, train: DataFrame, params: dict) -> PooledModel:
    columns = input_columns(train)
    if name in LINEAR:
        return _fit_pooled_line(name, train, columns, params)
    scaler = fit_scaler(train, columns)
    if name == "svr":
        vectorise = _random_waves(columns, params)
    elif name in ("random_forest", "gradient_boosting", "xgboost"):
        vectorise = lambda df: df.withColumn("features", F.array(*[F.col(c).cast("double") for c in columns]))
    else:
        vectorise = VectorAssembler(inputCols=columns, outputCol="features").transform
    number = params.get("partitions") or fit_partitions(train.count())
    laid_out = (
        scaler.apply(train)
        .repartition(number, "patient_id", "hour_ts")
        .sortWithinPartitions("patient_id", "hour_ts", "glucose", *columns)
    )
    label = F.col("glucose") - F.col("level")
    if name in TREES:
        # means and deviations depend in their last digits on the order of the rows, and splits on ties
        laid_out = laid_out.withColumns({c: F.round(c, 9) for c in columns})
        label = F.round(label, 9)
    key = F.xxhash64("patient_id", "hour_ts", "glucose")
    ready = vectorise(laid_out).select("features", label.alias("label"), key.alias("key")).persist()
    try:
        n = ready.count()
        if not n:
            raise ValueError("no complete training rows")
        if name == "gradient_boosting":  # without penalty; the first tree counts in full, as in Spark's learner
            model = boosting.fit_second_order(ready.withColumnRenamed("features", "x"), n, len(columns), {"penalty": 0.0, "first_rate": 1.0} | params)
        elif name == "xgboost":
            model = boosting.fit_second_order(ready.withColumnRenamed("features", "x"), n, len(columns), params)
        elif name == "random_forest":
            model = forest.fit_forest(ready.withColumnRenamed("features", "x"), n, len(columns), params)
        else:
            sized = {"memory_mb": tree_memory_mb(train.sparkSession)} | params
            model = _estimator(name, sized, n).fit(ready)
    finally:
        ready.unpersist()
    return PooledModel(name, scaler, vectorise, model, params)


# --- linear models per patient ---------------------------------------------


#: Lasso sweeps stop when no coefficient moves by more; past the last sweep the fit counts as not converged.
LASSO_TOLERANCE, LASSO_SWEEPS = 1e-10, 200_000


def _lasso(gram: np.ndarray, moment: np.ndarray, alpha: float) -> tuple[np.ndarray, bool]:
    """Minimise w'Gw/2 - m'w + alpha |w|_1 one coordinate at a time."""
    w = np.zeros(len(moment))
    for _ in range(LASSO_SWEEPS):
        moved = 0.0
        for j in np.flatnonzero(np.diag(gram) > 0):
            pull = moment[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / gram[j, j]
            moved = max(moved, abs(new - w[j]))
            w[j] = new
        if moved < LASSO_TOLERANCE:
            return w, True
    return w, False


def linear_score(columns: list[str]) -> Column:
    """Dot product with the ``coef`` array plus ``intercept``."""
    terms = [F.col(c) * F.col("coef")[i] for i, c in enumerate(columns)]
    return reduce(lambda a, b: a + b, terms, F.col("intercept"))


@dataclass(frozen=True)
class PatientLinearModel:
    """One row of coefficients per patient; scoring is a column expression."""

    algorithm: str
    coefficients: DataFrame
    columns: list[str]

    def stepper(self) -> tuple[DataFrame, Callable]:
        """See forecasting.forecast_recursive."""
        table = self.coefficients.where(F.col("coef").isNotNull()).select(
            "patient_id", F.col("coef").alias("a"), F.col("coef").alias("b"), F.col("intercept").alias("c")
        )
        return table, _one_row_each(lambda x, a, b, c: (x * a).sum(axis=1) + c)

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.join(
            self.coefficients.select("patient_id", "coef", "intercept"), "patient_id", "left"
        ).select(*rows.columns, linear_score(self.columns).alias("prediction"))


def fit_per_patient(name: str, train: DataFrame, params: dict) -> PatientLinearModel:
    columns = input_columns(train)
    return from_statistics(name, gram.statistics(train, columns), columns, params)


def from_statistics(name: str, table: DataFrame, columns: list[str], params: dict | None = None) -> PatientLinearModel:
    """The linear model of each patient from statistics made, or merged, earlier."""
    options = DEFAULT_PARAMS[name] | (params or {})
    return PatientLinearModel(name, gram.patient_coefficients(name, table, columns, options, _lasso), columns)


# --- nearest neighbours and seasonal models behind the same interface ------


@dataclass(frozen=True)
class NeighbourModel:
    train: DataFrame
    scaler: Scaler
    k: int
    algorithm: str = field(default="knn")

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` need distinct ``hour_ts`` within a patient."""
        known = self.scaler.apply(self.train)
        found = predict_neighbours(
            known, self.scaler.apply(rows), self.scaler.columns, k=self.k
        )
        return rows.join(found, ["patient_id", "hour_ts"], "left").select(*rows.columns, "prediction")


@dataclass(frozen=True)
class SeasonalModel:
    """Adapter that scores feature rows by their time alone."""

    model: object
    algorithm: str = field(default="prophet")

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.predict(rows, "hour_ts").select(
            *rows.columns, F.col("predicted_glucose").alias("prediction")
        )


def fit_model(name: str, train: DataFrame, scope: str = "pooled", **params):
    """Fit one of the ten algorithms on feature rows (or the grid, for ``prophet``).

    A fit and its predictions read ``train`` several times: hand in a table kept by
    ``durable`` or ``persist``, not a plan that starts at the readings.
    ``scope`` is ``pooled`` (one distributed fit over all patients) or ``patient`` (as many
    fits as patients, side by side; nearest neighbours and the seasonal models always work so).
    """
    check_algorithm(name)
    options = DEFAULT_PARAMS[name] | params
    if options.get("alpha", 0.0) < 0:
        raise ValueError(f"alpha must not be negative, as {options['alpha']} is")
    if name == "prophet":
        return SeasonalModel(SEASONAL_FITS["fourier" if options.get("fourier") else options["method"]](train))
    if name == "knn":
        columns = input_columns(train)
        return NeighbourModel(train, fit_scaler(train, columns), options["k"])
    if scope == "patient":
        if name in TREES:
            return trees.fit_patient_trees(name, train, options)
        if name == "svr":
            return kernel.fit_patient_kernels(name, train, options)
        return fit_per_patient(name, train, options)
    return fit_pooled(name, train, options)


def training_r2(model, train: DataFrame) -> DataFrame:
    """Share of variance explained on the training rows, per patient."""
    y, p = F.col("glucose"), F.col("prediction")
    return (
        model.predict(train)
        .groupBy("patient_id")
        .agg(
            F.count("*").alias("n"),
            (
                F.lit(1.0)
                - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))
            ).alias("r2"),
        )
        .withColumn("algorithm", F.lit(model.algorithm))
    )
