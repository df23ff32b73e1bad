"""Whitening of embeddings by the principal components of an exactly aggregated covariance.

Covariances come from variances alone (polarisation): for every dimension and every pair
of dimensions the squares of the centred values and of their sums are added up in whole
numbers, and cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. Tasks add small centred
integers, Spark adds the tasks' sums, and the driver gets one number for each dimension
and pair, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycospan.llm.common import deleted, written
from glycospan.llm.vectors import finite, floors, packed, unpacked, vectors_of

#: Entries become floor(64 * c). A constant shift of them (the digest has one) changes no result.
SCALE = 64
#: Floored entries are held in the range of a long, like a saturating conversion.
MOST = (1 << 63) - (1 << 21)
COMPONENTS = 16
#: Components whose variance is below this share of the largest are rounding, not directions.
LEAST_SHARE = 1e-11
#: Rows whose squares are added before they are turned into Python integers.
_ROWS = 4096
#: Magnitudes up to which the squares of sums of _ROWS rows fit 64 bits.
_SMALL = 1 << 24

_SUMS = "k int, high decimal(38,0), low decimal(38,0)"
_DEVIATION_LIMIT = 1 << 63


def _sum_rows(sums: dict[int, int]) -> pa.RecordBatch:
    """Exact sums as two decimals each, so that Spark can add numbers of any size."""
    high, low = [Decimal(v >> 64) for v in sums.values()], [Decimal(v & (1 << 64) - 1) for v in sums.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array(high, pa.decimal128(38, 0)), pa.array(low, pa.decimal128(38, 0))],
        names=["k", "high", "low"],
    )


def _added(parts: DataFrame) -> dict[int, int]:
    rows = parts.groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {r.k: (int(r.high) << 64) + int(r.low) for r in rows}


def column_sums(whole: np.ndarray) -> list[int]:
    small = not whole.size or np.abs(whole).max() < 1 << 40
    return [int(v) for v in (whole if small else whole.astype(object)).sum(axis=0)]


def square_sums(y: np.ndarray) -> list[int]:
    """Sums of the squares of each column, then of each sum of two columns, in the order of ``pairs``."""
    totals = [0] * (y.shape[1] * (y.shape[1] + 1) // 2)
    for at in range(0, len(y), _ROWS):
        part = y[at : at + _ROWS]
        big = part.dtype == object or np.abs(part).max() >= _SMALL
        part = np.asfortranarray(part.astype(object) if big else part)
        k = 0
        for i in range(part.shape[1]):
            sums = part[:, i:] + part[:, i : i + 1]
            sums[:, 0] = part[:, i]
            for v in (sums * sums).sum(axis=0).tolist():
                totals[k] += v
                k += 1
    return totals


def pairs(d: int) -> Iterator[tuple[int, int]]:
    return ((i, j) for i in range(d) for j in range(i, d))


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance of n rows from exact sums of squares around whole numbers near the means.

    ``rest`` is what the centred columns add up to. n * squares - rest^2 is n^2 times a
    variance, without rounding; only the final quotients are rounded, once each.
    """
    d = len(rest)
    single = [n * squares[i, i] - rest[i] ** 2 for i in range(d)]
    out = np.empty((d, d))
    for i, j in pairs(d):
        if i == j:
            out[i, i] = single[i] / n**2
        else:
            both = n * squares[i, j] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - single[i] - single[j]) / (2 * n**2)
    return out


@dataclass
class Whitening:
    """What rows are whitened with. ``near`` are whole numbers next to the means of the floored entries."""

    n: int
    near: list[int]
    rest: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, whole: np.ndarray) -> np.ndarray:
        """Whole numbers less ``near``: 64 bits where they fit."""
        if not whole.size or max(np.abs(whole).max(), *map(abs, self.near)) < 1 << 40:
            return whole - np.array(self.near, np.int64)
        return whole.astype(object) - np.array(self.near, object)

    def project(self, y: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return (y.astype(np.float64) - mean) @ (self.directions / np.sqrt(self.values))

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum of the squares of n * x - S, exact; None where a long cannot hold it.

        It is n^2 sum y^2 - 2 n sum y rest + sum rest^2, in which the two sums over y are small.
        """
        top = int(np.abs(y).max()) if y.size else 0
        fits = y.dtype != object and y.shape[1] * top * max(top, *map(abs, self.rest), 1) < 1 << 62
        rest = np.array(self.rest, np.int64 if fits else object)
        y = y if fits else y.astype(object)
        square, cross, own = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist(), sum(r * r for r in self.rest)
        exact = (self.n * self.n * s - 2 * self.n * c + own for s, c in zip(square, cross, strict=True))
        return [v if v < _DEVIATION_LIMIT else None for v in exact]


def _distinct(rows: DataFrame, d: int) -> DataFrame:
    """The packed floored vectors of ``d`` entries, each once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, matrix in finite(batch.column(0)):
                if matrix.shape[1] == d:
                    for _, data in packed(floors(matrix, SCALE, MOST)):
                        yield pa.RecordBatch.from_arrays([data], names=["x"])

    return rows.select("vector").mapInArrow(pack, "x binary").distinct()


def _common_length(rows: DataFrame) -> int:
    """The length that most usable vectors have (the smaller of two alike), or 0."""
    usable = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    lengths = rows.where(F.col("vector").isNotNull() & usable).groupBy(F.size("vector").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), "d").first()
    return most.d if most else 0


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct floored vectors; None without any. ``rows`` have ``vector``."""
    d = _common_length(rows)
    if not d:
        return None
    vectors, path = written(_distinct(rows, d))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for batch in batches:
            for found, whole in unpacked(batch.column(0)):
                total = [a + b for a, b in zip(total, [*column_sums(whole), len(found)], strict=True)]
        if total[d]:
            yield _sum_rows(dict(enumerate(total)))

    total = _added(vectors.mapInArrow(sums, _SUMS))
    n = total[d]
    near = [(2 * total[i] + n) // (2 * n) for i in range(d)]
    rest = [total[i] - n * near[i] for i in range(d)]
    model = Whitening(n, near, rest, np.zeros((d, 0)), np.zeros(0), np.zeros(0))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, whole in unpacked(batch.column(0)):
                found = square_sums(model.centred(whole))
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total:
            yield _sum_rows(dict(enumerate(total)))

    added = _added(vectors.mapInArrow(squares, _SUMS))
    matrix = covariance(n, rest, {pair: added[k] for k, pair in enumerate(pairs(d))})
    values, directions = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * LEAST_SHARE]
    trace = float(np.trace(matrix))
    model.directions, model.values = directions[:, order], values[order]
    model.explained = model.values / trace if trace else model.values
    model.identity_error = _identity_error(vectors, model)
    deleted(rows.sparkSession, path)
    return model


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity, measured on it."""
    m = len(model.values)
    if not m:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for batch in batches:
            for _, whole in unpacked(batch.column(0)):
                z = model.project(model.centred(whole))
                total += np.vstack([z.sum(axis=0), z.T @ z])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    rows = vectors.mapInArrow(moments, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((m + 1) * m)
    total[[r.k for r in rows]] = [r.v for r in rows]
    mean, second = np.split(total.reshape(m + 1, m) / model.n, [1])
    return float(np.abs(second - mean.T @ mean - np.eye(m)).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, or hold a null or non-finite entry, are left out, and so are those
    whose length is not the one that most have. Repeated rows are all returned but count once
    in the fit; a null id stays null. Components without variance are left out, so a table
    whose usable vectors are all alike, or an empty one, gives no rows. ``deviation`` is null
    where a long cannot hold it. The fit runs jobs when called; its vectors are shuffled once,
    packed, after the copies in a task are merged. Whitening itself is one pass over the rows.
    """
    rows = vectors_of(df, id_col, vector_col)
    model = fit(rows.select("vector"), components)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], _OUT)
    d, m = len(model.near), len(model.values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, _ROWS):
                batch = whole_batch.slice(at, _ROWS)
                for found, matrix in finite(batch.column("vector")):
                    if matrix.shape[1] != d:
                        continue
                    y = model.centred(floors(matrix, SCALE, MOST))
                    count = len(found)
                    ids = batch.column("vec_id").take(pa.array(np.repeat(found, m)))
                    deviation = pa.array(model.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(count), m)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)),
                            pa.array(np.full(count * m, model.n)),
                            deviation,
                            pa.array(model.project(y).ravel()),
                            pa.array(np.tile(model.explained, count)),
                            pa.array(np.full(count * m, model.identity_error)),
                        ],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return rows.mapInArrow(apply, _OUT)
