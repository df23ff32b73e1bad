"""Linear text classifiers on n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glycospan.llm.common import slices, texts_of

#: Hash buckets of features: a fixed 4 MB table of weights is all that is sent to the tasks.
BUCKETS = 1 << 20
#: Labelled rows of each class that a model is fitted on, those with the smallest hash of their id.
MAX_PER_CLASS = 4000
#: A feature takes part if at least so many training texts hold it and its shares of the classes' texts differ by so many standard errors.
LEAST_TEXTS, ERRORS = 5, 3.0

#: (texts) -> (text number of each feature occurrence, its bucket): distinct pairs, in order.
Features = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


@dataclass
class Model:
    """Weights by bucket and the sigmoid that turns a margin into a score."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    features: Features

    def margins(self, texts: list[str]) -> np.ndarray:
        rows, buckets = self.features(texts)
        return self.bias + np.bincount(rows, self.weights[buckets], len(texts))

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.clip(self.slope * self.margins(texts) + self.shift, -500, 500)
        return 1 / (1 + np.exp(-z))


def distinct(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, bucket) once."""
    keys = np.unique(rows.astype(np.int64) * BUCKETS + buckets)
    return keys // BUCKETS, keys % BUCKETS


def log_count_ratios(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of (share of a feature among the features of class 1) over (that of class 0), by bucket.

    ``counts`` has the texts of class 0 and of class 1 that hold each bucket.
    """
    seen = counts.sum(axis=0) > 0
    smooth = counts + smoothing
    shares = smooth / np.maximum(smooth[:, seen].sum(axis=1, keepdims=True), 1e-12)
    return np.where(seen, np.log(shares[1] / shares[0]), 0.0)


def informative(counts: np.ndarray, texts: np.ndarray, least: int = LEAST_TEXTS, z: float = ERRORS) -> np.ndarray:
    """Buckets in at least ``least`` texts whose share of texts differs between the classes by ``z`` standard errors."""
    n, total = texts.astype(float), counts.sum(axis=0)
    p = total / n.sum()
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n[0] + 1 / n[1]))
    return (total >= least) & (np.abs(counts[1] / n[1] - counts[0] / n[0]) > z * error)


def dual_coordinate_descent(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, labels: np.ndarray, cost: np.ndarray, tolerance: float = 1e-3, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Linear hinge-loss machine: weights and bias (a feature that is always 1).

    Goes through the texts in a seeded random order and sets each dual variable to its
    optimum between 0 and the text's cost, until in a round no projected gradient exceeds
    the tolerance.
    """
    n = len(labels)
    ends = np.searchsorted(rows, np.arange(n + 1))
    y = np.where(labels > 0, 1.0, -1.0)
    norms = 1.0 + np.bincount(rows, values**2, n)
    w, bias, alpha, random = np.zeros(BUCKETS), 0.0, np.zeros(n), np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for i in random.permutation(n):
            part = slice(ends[i], ends[i + 1])
            at, x = buckets[part], values[part]
            gradient = y[i] * (w[at] @ x + bias) - 1
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost[i] else gradient
            if projected:
                worst = max(worst, abs(projected))
                new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[at] += step * x
                bias += step
        if worst < tolerance:
            break
    return w, bias


def sigmoid(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, with the targets drawn in as for few rows (Newton steps)."""
    n1, n0 = (labels > 0).sum(), (labels == 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margins).sum() + 1e-6 * (a - 1), d.sum()])
        hessian = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def training_rows(df: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str, text_col: str, label_id_col: str, most: int) -> list[tuple[str, int]]:
    """Texts and labels of at most ``most`` rows of each class, those whose id has the smallest hash.

    ``learn`` says, on a column doc_id, which labels may be used. Rows with a null id or
    label are left out; an id with several labels takes the smallest, one with several texts
    too (null last). The chosen ids are few
    by that bound, so they are broadcast to the documents.
    """
    marked = labels.select(F.col(f"`{label_id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = None
    for y in (0, 1):
        some = marked.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = texts_of(df, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNull().alias("missing"), "text", "label")).alias("row"))
    return [(r.row.text or "", r.row.label) for r in sorted(rows.toLocalIterator(), key=lambda r: r.doc_id)]


def fit(rows: list[tuple[str, int]], features: Features, cost: float = 0.1, least_texts: int = LEAST_TEXTS, errors: float = ERRORS) -> Model:
    """A support vector machine on indicators times log-count ratios.

    Only features that ``informative`` chooses take part; the rule is the same for any number
    of rows, and without such a feature all texts have one score. Both classes weigh alike
    in the fit. Every fifth row of a class, the first included, is left out of it and fixes
    the sigmoid. With fewer than two rows of a class there is nothing to learn: the score
    is the share of class 1, or one half without any row.
    """
    labels = np.array([y for _, y in rows], np.int64)
    if min(np.bincount(labels, minlength=2)) < 2:
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))), features)
    place = np.zeros(len(labels), np.int64)
    for y in (0, 1):  # every fifth row of each class
        place[labels == y] = np.arange((labels == y).sum())
    fitted = place % 5 != 0

    def in_parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(rows), 100):  # features of all rows at once would fill the driver
            at, buckets = features([t for t, _ in rows[i : i + 100]])
            yield at + i, buckets

    counts = np.zeros((2, BUCKETS))
    for at, buckets in in_parts():
        for y in (0, 1):
            counts[y] += np.bincount(buckets[fitted[at] & (labels[at] == y)], minlength=BUCKETS)
    use = informative(counts, np.bincount(labels[fitted], minlength=2), least_texts, errors)
    ratios = np.where(use, log_count_ratios(counts), 0.0)
    parts = [(at[ratios[buckets] != 0], buckets[ratios[buckets] != 0]) for at, buckets in in_parts()]
    at, buckets = (np.concatenate(x) for x in zip(*parts, strict=True))
    inner = fitted[at]
    number = np.cumsum(fitted) - 1
    x = (number[at[inner]], buckets[inner], ratios[buckets[inner]])
    y = labels[fitted]
    balance = len(y) / (2 * np.bincount(y, minlength=2))[y]
    w, bias = dual_coordinate_descent(*x, y, cost * balance)
    model = Model((w * ratios).astype(np.float32), float(bias), 1.0, 0.0, features)
    margins = bias + np.bincount(at, model.weights[buckets], len(labels))
    model.slope, model.shift = sigmoid(margins[~fitted], labels[~fitted])
    return model


def score(df: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null text counts as empty."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = sent.value.scores([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = texts_of(df, id_col, text_col).mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
