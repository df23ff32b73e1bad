"""Hard-negative mining by threshold joins with suffix-norm bounds.

Anchors, in blocks of bounded size, are joined with all rows that reach a threshold of the
anchor. Dimensions are taken in blocks, in falling order of their energy. A row is indexed
in its leading blocks only: the rest is omitted once its norm, times the largest anchor
norm, stays below the lowest threshold, since it cannot reach a threshold by itself. The
index adds up partial scores; what remains after it is bounded by the product of the
remaining norms, and only pairs that can still reach their threshold are completed.

Each wanted list is a window: the first ``k`` rows with a score between ``low`` and
``high``. Its threshold starts high, is raised inside a task as soon as the task has found
``k`` rows, and is lowered from round to round until the window is filled or ``low`` is
reached, so results are exact whatever the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycospan.llm.common import deleted, partitions, written
from glycospan.llm.vectors import finite, floors, packed, unpacked, vectors_of

#: Components become floor(256 * c), held in a range in which products of 8,191 of them fit 64 bits.
SCALE, MOST = 256, 1 << 25
#: Anchors that are joined at a time; they and their windows are sent to the tasks.
ANCHORS = 16_384
#: Rows, those with the smallest hash of their id, whose scores set the first thresholds.
SEEDS = 2_048
#: Dimensions of a block of the index.
BLOCK = 8
#: Pairs of anchors and rows that a task scores at a time.
PAIRS = 2_000_000
_LOWEST = -(1 << 62)
_HIGHEST = 1 << 62


# --- the threshold join ------------------------------------------------------


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of what is left of each row from the start of each block of dimensions on; 0 at the end."""
    squares = np.add.reduceat((x.astype(np.float64) ** 2), np.arange(0, x.shape[1], BLOCK), axis=1)
    rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.hstack([np.sqrt(rest) * (1 + 1e-9), np.zeros((len(x), 1))])


def _kind(q: np.ndarray, r: np.ndarray) -> type:
    """The fastest type in which all partial scores are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * q.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def scores_above(q: np.ndarray, r: np.ndarray, at_least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of r, inner product) of the pairs whose product is at least ``at_least`` of q's row.

    All numbers are whole and the products exact. ``q`` and ``r`` have the same columns.
    """
    none = np.zeros(0, np.int64)
    if not len(q) or not len(r) or not q.shape[1]:
        pairs = np.argwhere(np.broadcast_to((at_least <= 0)[:, None], (len(q), len(r))))
        return pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64)
    rest_q, rest_r = suffix_norms(q), suffix_norms(r)
    blocks = rest_q.shape[1] - 1
    lowest, longest = float(at_least.min()), float(rest_q[:, 0].max())
    # blocks in which a row is indexed: beyond them it reaches no threshold
    indexed = (rest_r[:, :-1] * longest >= lowest).sum(axis=1)
    if not indexed.any():
        return none, none, none
    order = np.argsort(-indexed, kind="stable")
    order = order[: np.count_nonzero(indexed)]
    indexed, rest_r = indexed[order], rest_r[order]
    kind = _kind(q, r)
    left, right = q.astype(kind), r[order].astype(kind)
    partial = np.zeros((len(q), len(order)), kind)
    for b in range(indexed[0]):
        long = np.count_nonzero(indexed > b)  # the posting list of the block: a prefix of the rows
        span = slice(b * BLOCK, (b + 1) * BLOCK)
        partial[:, :long] += left[:, span] @ right[:long, span].T
    found = []
    for b in np.unique(indexed):
        first, last = np.searchsorted(-indexed, [-b, -b + 1])
        reach = partial[:, first:last] + rest_q[:, b : b + 1] * rest_r[None, first:last, b] if b < blocks else partial[:, first:last]
        i, j = np.nonzero(reach >= at_least[:, None].astype(np.float64))
        j = j + first
        score = partial[i, j].astype(np.int64)
        for c in range(b, blocks):  # complete the survivors, dropping those that fall behind
            span = slice(c * BLOCK, (c + 1) * BLOCK)
            score = score + np.einsum("ij,ij->i", q[i, span], r[order[j], span])
            open_ = score + rest_q[i, c + 1] * rest_r[j, c + 1] >= at_least[i]
            i, j, score = i[open_], j[open_], score[open_]
        sure = score >= at_least[i]
        found.append((i[sure], order[j[sure]], score[sure]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


# --- windows of anchors --------------------------------------------------------


@dataclass
class Windows:
    """The wanted lists of a block of anchors: for list w, the first ``k`` rows for anchor ``anchor[w]``
    with low <= score <= high. ``start[w]`` is the threshold of this round, at least ``low[w]``."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    start: np.ndarray
    k: int
    #: rows must have the anchor's label, and another id; otherwise another label
    same_label: bool
    partner: np.ndarray | None = None
    partner_score: np.ndarray | None = None

    def only(self, which: np.ndarray) -> Windows:
        cut = {f: getattr(self, f) for f in ("anchor", "low", "high", "start", "partner", "partner_score")}
        return replace(self, **{f: None if v is None else v[which] for f, v in cut.items()})


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


@dataclass
class Best:
    """The first k rows of each window so far."""

    windows: Windows
    window: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, anchor: np.ndarray, row: np.ndarray, score: np.ndarray, lists: np.ndarray) -> None:
        """Take rows in, given by anchor; ``lists`` has the windows of each anchor, -1 behind the last."""
        w = self.windows
        window, rows, scores = [self.window], [self.row], [self.score]
        for slot in range(lists.shape[1]):
            mine = lists[anchor, slot]
            fits = (mine >= 0) & (score >= w.start[mine]) & (score <= w.high[mine])
            window.append(mine[fits])
            rows.append(row[fits])
            scores.append(score[fits])
        window, rows, scores = map(np.concatenate, (window, rows, scores))
        order = np.lexsort((rows, -scores, window))
        window, rows, scores = window[order], rows[order], scores[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        near = place < w.k
        self.window, self.row, self.score = window[near], rows[near], scores[near]
        full = place[near] == w.k - 1  # k rows are there: none below them can matter
        w.start[self.window[full]] = np.maximum(w.start[self.window[full]], self.score[full])


def _lists(windows: Windows, anchors: int) -> np.ndarray:
    order = np.argsort(windows.anchor, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(windows.anchor[order], windows.anchor[order])
    out = np.full((anchors, place.max(initial=-1) + 1), -1, np.int64)
    out[windows.anchor[order], place] = order
    return out


def fill(anchors: Anchors, windows: Windows, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Best:
    """The first rows of each window among those of ``batches`` (ids, labels, vectors)."""
    windows = replace(windows, start=windows.start.copy())
    best, lists = Best(windows), _lists(windows, len(anchors.ids))
    asked = np.flatnonzero((lists >= 0).any(axis=1))
    for ids, labels, vectors in batches:
        groups = [(y, asked[anchors.labels[asked] == y], np.flatnonzero(labels == y)) for y in np.intersect1d(labels, anchors.labels[asked])] if windows.same_label else [(None, asked, np.arange(len(ids)))]
        for _, some, rows in groups:
            step = max(16, PAIRS // max(len(some), 1))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                at_least = np.where(lists[some] >= 0, windows.start[lists[some]], _HIGHEST).min(axis=1)
                i, j, score = scores_above(anchors.vectors[some], vectors[part], at_least)
                i, j = some[i], part[j]
                fits = ids[j] != anchors.ids[i] if windows.same_label else labels[j] != anchors.labels[i]
                best.add(i[fits], ids[j[fits]], score[fits], lists)
    return best


# --- Spark -----------------------------------------------------------------------


def _prepared(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label and packed vector of the rows that take part, one for each id, written evenly."""
    rows = vectors_of(df, id_col, vector_col, label_col)
    rows = rows.select("vec_id", F.col("more_0").cast("long").alias("label"), "vector").where("vec_id is not null and label is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, matrix in finite(batch.column("vector")):
                for some, data in packed(floors(matrix, SCALE, MOST)):
                    at = pa.array(found[some])
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), data], names=["vec_id", "label", "x"])

    done = rows.mapInArrow(pack, "vec_id long, label long, x binary").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row"))
    return done.select("vec_id", "row.label", "row.x").repartition(partitions(df), "vec_id")


def _dense(column: pa.Array, width: int, order: np.ndarray | None = None) -> np.ndarray:
    """The vectors with ``width`` columns, zeros behind shorter ones, columns in ``order``."""
    out = np.zeros((len(column), width), np.int64)
    for rows, matrix in unpacked(column):
        cut = matrix[:, :width]
        out[rows[:, None], np.arange(cut.shape[1])] = cut
    return out if order is None else out[:, order]


def _width(column: pa.Array) -> int:
    return max((m.shape[1] for _, m in unpacked(column)), default=0)


_FOUND = "anchor_id long, partner_id long, partner_score long, lowest boolean, vec_id long, score long"


def _search(rows: DataFrame, anchors: Anchors, windows: Windows, order: np.ndarray) -> DataFrame:
    """The first k rows of each window: _FOUND, with the number ``n`` of rows of the window and their ``place``."""
    width = anchors.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((b.column("vec_id").to_numpy(), b.column("label").to_numpy(), _dense(b.column("x"), width, order)) for b in batches if b.num_rows)
        best = fill(anchors, windows, parts)
        w = best.window
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchors.ids[windows.anchor[w]]),
                pa.array(windows.partner[w]),
                pa.array(windows.partner_score[w]),
                pa.array(windows.start[w] <= windows.low[w]),
                pa.array(best.row),
                pa.array(best.score),
            ],
            names=["anchor_id", "partner_id", "partner_score", "lowest", "vec_id", "score"],
        )

    window = Window.partitionBy("anchor_id", "partner_id")
    place = F.row_number().over(window.orderBy(F.desc("score"), "vec_id"))
    return rows.mapInArrow(run, _FOUND).withColumn("place", place).where(F.col("place") <= windows.k).withColumn("n", F.count("*").over(window))


def _positive_windows(anchors: Anchors, seeds: Anchors, k: int) -> Windows:
    """Every anchor's first k rows of its label; the k-th among the seeds is the threshold, if there are k."""
    n = len(anchors.ids)
    low = np.full(n, _LOWEST)
    windows = Windows(np.arange(n), low, np.full(n, _HIGHEST), low.copy(), k, True, np.zeros(n, np.int64), np.zeros(n, np.int64))
    best = fill(anchors, windows, iter([(seeds.ids, seeds.labels, seeds.vectors)]))
    return replace(windows, start=best.windows.start)


def _negative_windows(anchors: Anchors, seeds: Anchors, share: float, k: int, least: int, most: int, found: tuple[np.ndarray, ...]) -> Windows:
    """A window for each anchor and positive; it starts where the seeds promise k rows, or at its low end."""
    anchor, partner, score = found
    low, high = -((-least * score) // 100), (most * score) // 100
    real = low <= high
    anchor, partner, score, low, high = (v[real] for v in (anchor, partner, score, low, high))
    windows = Windows(anchor, low, high, low.copy(), max(1, int(np.ceil(k * share))), False, partner, score)
    best = fill(anchors, windows, iter([(seeds.ids, seeds.labels, seeds.vectors)]))
    return replace(windows, start=best.windows.start, k=k)


def mine(
    df: DataFrame,
    is_anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on a column vec_id (every 50th id by default). Rows without
    id, label or vector, or with a null or non-finite component, take no part; of rows with
    one id the least label and vector stays. Shorter vectors count as filled up with zeros,
    and components beyond 131,072 are held there. Ties go to the smaller id. A negative is a
    row of another label with least % to most % of the positive's score; a negative positive
    score has none. Anchors without positives, and empty tables, give no rows.

    Each block of 16,384 anchors is sent to all tasks and scanned past all rows, a few times;
    positives of a block, 5 for each anchor, are the most that reaches the driver. Results
    are written to the shared folder.
    """
    spark = df.sparkSession
    is_anchor = F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor
    rows, path = written(_prepared(df, id_col, label_col, vector_col))
    asked = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), asked.count()
    seed_rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow().combine_chunks()
    blocks, tables = -(-n_anchors // ANCHORS), []
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)) == block).toArrow().combine_chunks().sort_by("vec_id")
        if not some.num_rows:
            continue
        x = some.column("x").combine_chunks()
        vectors, width = _dense(x, _width(x)), _width(x)
        seed_vectors = _dense(seed_rows.column("x").combine_chunks(), width)
        order = np.argsort(-(seed_vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        anchors = Anchors(some.column("vec_id").to_numpy(), some.column("label").to_numpy(), vectors[:, order])
        seeds = Anchors(seed_rows.column("vec_id").to_numpy(), seed_rows.column("label").to_numpy(), seed_vectors[:, order])
        found = _search(rows, anchors, _positive_windows(anchors, seeds, positives), order).select("anchor_id", "vec_id", "score").toArrow()
        at = np.searchsorted(anchors.ids, found.column("anchor_id").to_numpy())
        windows = _negative_windows(anchors, seeds, len(seeds.ids) / n_rows, negatives, least, most, (at, found.column("vec_id").to_numpy(), found.column("score").to_numpy()))
        while len(windows.anchor):
            settled = F.col("lowest") | (F.col("n") == negatives)
            done, table = written(_search(rows, anchors, windows, order).where(settled))
            tables.append(table)
            filled = done.where(F.col("place") == 1).select("anchor_id", "partner_id").toArrow()
            filled = set(zip(filled.column(0).to_pylist(), filled.column(1).to_pylist(), strict=True))
            open_ = [key not in filled for key in zip(anchors.ids[windows.anchor].tolist(), windows.partner.tolist(), strict=True)]
            windows = windows.only(np.array(open_) & (windows.start > windows.low))
            reach = np.maximum(4 * (windows.high - windows.start), (windows.high - windows.low) // 16 + 1)
            windows.start = np.maximum(windows.low, np.minimum(windows.start, windows.high - reach))
    deleted(spark, path)
    result = spark.read.parquet(*tables) if tables else spark.createDataFrame([], _FOUND + ", place int, n long")
    return result.select(
        "anchor_id",
        F.col("partner_id").alias("positive_id"),
        F.col("place").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("partner_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
