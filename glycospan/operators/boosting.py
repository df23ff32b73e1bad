"""Second-order gradient boosting over all patients, from histograms that Spark adds up.

Inputs are cut into at most 256 bins of about equal counts. For every level of a tree Spark
adds gradients and Hessians by node, input and bin; the driver gets these sums, a bounded
table, and picks the splits by gain ½(GL²/(HL+λ) + GR²/(HR+λ) − G²/(H+λ)) − γ. Leaves are
−G/(H+λ). Gradients are added as whole numbers, so a fit is the same on any cluster.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glycospan.operators.trees import FlatTrees
from glycospan.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS, FINE_BINS = 256, 1 << 14
#: Rows that a task of a pass reads, at least, and at most where there are more tasks than TASKS_PER_CORE
#: for each core; sums of whole numbers don't depend on it.
ROWS_PER_TASK, MOST_ROWS_PER_TASK, TASKS_PER_CORE = 50_000, 1_000_000, 2
#: Rounds after which the margins so far are written to the checkpoint folder, which cuts their lineage.
KEPT_ROUNDS = 20
#: Gradients (at most 61 bits) are added as two halves, over so few rows that doubles hold the sums.
HALF, ROWS_EXACT, EXACT = 24, 1 << 14, float(1 << 53)
#: Tasks whose histograms the driver adds up itself; those of more are added by tasks before.
FEW_TASKS = 32
#: Blocks of rows are arrays; a round's go once the next one's are made.
STORED = StorageLevel.MEMORY_AND_DISK
Block = tuple[np.ndarray, np.ndarray, np.ndarray]
Sums = tuple[np.ndarray, np.ndarray, np.ndarray]
Histograms = dict[int, tuple[np.ndarray, np.ndarray]]


def cut_points(rows: DataFrame, n: int, inputs: int) -> list[np.ndarray]:
    """Thresholds between the bins of each input of the array column ``x``.

    Values are counted in 16,384 equal parts of an input's range; runs of parts are joined to
    bins by their share of the rows. A threshold lies half way between the values around it.
    """
    long = rows.select(F.posexplode("x").alias("input", "v"))
    ranges = F.broadcast(long.groupBy("input").agg(F.min("v").alias("low"), F.max("v").alias("high")))
    part = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * FINE_BINS), F.lit(0))
    fine = (
        long.join(ranges, "input")
        .groupBy("input", F.least(part, F.lit(FINE_BINS - 1)).alias("fine"))
        .agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    )
    upto = F.sum("n").over(Window.partitionBy("input").orderBy("fine"))
    bins = (
        fine.withColumn("bin", F.floor((upto - F.col("n")) * F.lit(BINS) / F.lit(n)))
        .groupBy("input", "bin")
        .agg(F.min("least").alias("least"), F.max("most").alias("most"))
    )
    after = F.lead("least").over(Window.partitionBy("input").orderBy("bin"))
    cuts = bins.select("input", (F.col("most") + (after - F.col("most")) / 2).alias("cut")).where("cut is not null").toPandas()
    return [np.sort(cuts.loc[cuts["input"] == i, "cut"].to_numpy(float)) for i in range(inputs)]


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Blocks of at most ROWS_EXACT rows: their labels, and their bins input by input, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS_EXACT) for whole in batches for at in range(0, whole.num_rows, ROWS_EXACT)):
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = np.array([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], np.uint8)
            label = batch.column("label").to_numpy().astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (label, bins)], names=["label", "bins"])

    return rows.select("label", "x").mapInArrow(run, "label binary, bins binary")


def _nodes(splits: dict[int, tuple[int, int]], bins: np.ndarray) -> np.ndarray:
    """The node of each row: nodes are numbered like a heap, from 1."""
    at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
    feature, cut = (np.full(2 * max(splits, default=0) + 2, -1) for _ in range(2))
    for node, split in splits.items():
        feature[node], cut[node] = split
    while (inner := (f := feature[at]) >= 0).any():
        at = np.where(inner, 2 * at + (bins[rows, np.maximum(f, 0)] > cut[at]), at)
    return at


def _moved(margin: np.ndarray, bins: np.ndarray, tree: tuple) -> np.ndarray:
    splits, _, value = tree
    leaf = np.zeros(max(value) + 1)
    leaf[list(value)] = list(value.values())
    return margin + leaf[_nodes(splits, bins)]


def _started(table: DataFrame, base: float, inputs: int) -> RDD:
    """(labels, margins, bins by input and row) of each block."""

    def arrays(row) -> Block:
        label = np.frombuffer(bytes(row.label))
        return label, np.full(len(label), base), np.frombuffer(bytes(row.bins), np.uint8).reshape(inputs, -1)

    return table.rdd.map(arrays)


def _sums(blocks: Iterable[Block], splits: dict, open_: list[int], inputs: int, unit: float) -> Sums:
    """(place, gradients, counts) of the open nodes' cells that have rows, by node, input and bin."""
    span = len(open_) * BINS
    lookup = np.full(2 * max(open_) + 2, -1)
    lookup[open_] = np.arange(len(open_))
    g, h = np.zeros((inputs, span), np.int64), np.zeros((inputs, span), np.int64)
    for label, margin, bins in blocks:
        gradient = np.rint((label - margin) * unit).astype(np.int64)
        if splits:
            node = _nodes(splits, bins.T)
            slot = np.where(node < len(lookup), lookup[np.minimum(node, len(lookup) - 1)], -1)
            mine = np.flatnonzero(slot >= 0)
            first, gradient, bins = slot[mine] * BINS, gradient[mine], bins[:, mine]
        else:
            first = np.zeros(len(label), np.int64)
        if not len(gradient):
            continue
        # where sums over so many rows are not exact in doubles, those of two halves are
        whole = float(np.abs(gradient).max()) * len(gradient) < EXACT
        high = (gradient if whole else gradient >> HALF).astype(float)
        low = None if whole else (gradient & ((1 << HALF) - 1)).astype(float)
        for f in range(inputs):
            at = first + bins[f]
            some = np.bincount(at, high, span).astype(np.int64)
            g[f] += some if whole else (some << HALF) + np.bincount(at, low, span).astype(np.int64)
            h[f] += np.bincount(at, minlength=span)
    g, h = (v.reshape(inputs, len(open_), BINS).transpose(1, 0, 2).ravel() for v in (g, h))
    seen = np.flatnonzero(h)
    return seen, g[seen], h[seen]


def _added(one: Sums, two: Sums) -> Sums:
    place, at = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    sums = [np.zeros(len(place), np.int64) for _ in range(2)]
    for total, a, b in zip(sums, one[1:], two[1:], strict=True):
        np.add.at(total, at, np.concatenate([a, b]))
    return place, *sums


def _histograms(parts: list[Sums], open_: list[int], inputs: int) -> Histograms:
    """(gradients, counts) of each open node by input and bin, from the sums of tasks."""
    shape = (len(open_), inputs, BINS)
    g, h = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for place, some, count in parts:
        g.ravel()[place] += some
        h.ravel()[place] += count
    return {node: (g[i], h[i]) for i, node in enumerate(open_)}


def _later(block: Block, tree: tuple) -> Block:
    """A block after one more tree."""
    label, margin, bins = block
    return label, _moved(margin, bins.T, tree), bins


def _best(g: np.ndarray, h: np.ndarray, penalty: float, least_weight: float) -> tuple[float, int, int]:
    """(gain, input, last bin on the left) of the best split of a node; inputs by row, bins by column."""
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    total, weight = g[0].sum(), h[0].sum()
    gr, hr = total - gl, weight - hl
    allowed = (hl >= max(least_weight, 1)) & (hr >= max(least_weight, 1)) & (h[:, :-1] > 0)
    gain = gl.astype(float) ** 2 / np.maximum(hl + penalty, 1e-300) + gr.astype(float) ** 2 / np.maximum(hr + penalty, 1e-300) - float(total) ** 2 / (weight + penalty)
    gain = np.where(allowed, gain, -np.inf)
    at = int(np.argmax(gain))
    return float(gain.flat[at]), *divmod(at, gain.shape[1])


def _tree(histograms: Callable[[dict, list[int]], Histograms], k: int, params: dict, unit: float) -> tuple[dict, dict, dict]:
    """(splits, gains, values times rate) of tree ``k``; ``histograms`` gives those of open nodes below the splits so far."""
    penalty = params.get("penalty", 1.0)
    splits: dict[int, tuple[int, int]] = {}
    gains: dict[int, float] = {}
    value: dict[int, float] = {}
    open_, asked, sums = [1], [1], {}
    for level in range(params["depth"] + 1):
        above, sums = sums, {}
        if level < params["depth"]:
            sums = histograms(splits, asked)
            # rows of a node that are not in one child are in the other
            sums |= {i ^ 1: tuple(a - b for a, b in zip(above[i // 2], sums[i], strict=True)) for i in asked if i > 1}
        following, asked = [], []
        for i in open_ if sums else []:
            g, h = sums[i]
            value.setdefault(i, g[0].sum() / (h[0].sum() + penalty) / unit)
            gain, feature, cut = _best(g, h, penalty, params.get("least_weight", 1.0))
            gain /= unit**2
            if gain > max(2 * params.get("least_gain", 0.0), 1e-12 * float(g[0].sum()) ** 2 / unit**2, 1e-9):
                splits[i], gains[i] = (feature, cut), gain
                following += [2 * i, 2 * i + 1]
                asked.append(2 * i + int(2 * h[feature, : cut + 1].sum() > h[feature].sum()))
                # the sums of a child are those of the bins on its side
                low, all_, count = slice(0, cut + 1), g[feature].sum(), h[feature].sum()
                gl, hl = g[feature, low].sum(), h[feature, low].sum()
                value[2 * i] = gl / (hl + penalty) / unit
                value[2 * i + 1] = (all_ - gl) / (count - hl + penalty) / unit
        open_ = following
        if not open_:
            break
    rate = params.get("first_rate", params["rate"]) if k == 0 else params["rate"]
    return splits, gains, {i: rate * v for i, v in value.items()}


def _trees_of_one_task(blocks: list[Block], inputs: int, params: dict, unit: float) -> list:
    trees = []
    for k in range(params["iterations"]):
        trees.append(_tree(lambda splits, asked: _histograms([_sums(blocks, splits, asked, inputs, unit)], asked, inputs), k, params, unit))
        blocks = [_later(block, trees[-1]) for block in blocks]
    return trees


def _trees_of_many_tasks(blocks: RDD, tasks: int, inputs: int, params: dict, unit: float) -> list:
    """A pass for each level: tasks add their rows, Spark the tasks; sums of few tasks come to the driver as they are."""
    trees, done = [], None
    blocks = blocks.persist(STORED)

    def histograms(splits: dict, asked: list[int]) -> Histograms:
        nonlocal done
        parts = blocks.mapPartitions(lambda mine: [_sums(mine, splits, asked, inputs, unit)])
        found = _histograms([parts.treeReduce(_added)] if tasks > FEW_TASKS else parts.collect(), asked, inputs)
        if done is not None:  # the pass has read what its blocks were made from
            done.unpersist()
            done = None
        return found

    for k in range(params["iterations"]):
        trees.append(_tree(histograms, k, params, unit))
        if k + 1 < params["iterations"]:
            # made by the next pass, and kept for the others of its tree
            blocks, done = blocks.map(partial(_later, tree=trees[-1])).persist(STORED), blocks
            if (k + 1) % KEPT_ROUNDS == 0:
                blocks.checkpoint()
    blocks.unpersist()
    return trees


def fit_second_order(rows: DataFrame, n: int, inputs: int, params: dict) -> FlatTrees:
    """Boosted trees on ``label`` by the array column ``x`` of ``rows``, of which there are ``n``.

    The first tree counts ``first_rate``, if given, others ``rate``. Rows that a single task of a
    pass would read are boosted in that task; the trees are the same.
    """
    cuts = cut_points(rows, n, inputs)
    base, most = rows.agg(F.avg("label"), F.max(F.abs("label"))).first()
    base = round(base, 9)  # sums of doubles differ in their last digits from run to run
    # gradients in whole units so small that n of them fit a long
    bits = int(min(32, 61 - np.ceil(np.log2(n)) - np.ceil(np.log2(max(4 * most, 1.0)))))
    unit = float(2**bits)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(1 + n // ROWS_PER_TASK, max(TASKS_PER_CORE * cores, -(-n // MOST_ROWS_PER_TASK)))
    table = durable(_binned(rows, cuts).coalesce(tasks))  # there may be hundreds of short passes
    blocks = _started(table, base, inputs)
    if tasks == 1:
        (trees,) = blocks.mapPartitions(lambda mine: [_trees_of_one_task(list(mine), inputs, params, unit)]).collect()
    else:
        trees = _trees_of_many_tasks(blocks, tasks, inputs, params, unit)
    return _flat(trees, cuts, base)


def _leaves(splits: dict[int, tuple[int, int]]) -> list[int]:
    return [1] if not splits else [c for i in splits for c in (2 * i, 2 * i + 1) if c not in splits]


def _flat(trees: list, cuts: list[np.ndarray], base: float) -> FlatTrees:
    columns: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value", "gain")}
    roots = []
    for splits, gains, value in trees:
        ids = sorted({1, *splits, *_leaves(splits)})
        at = {i: len(columns["feature"]) + j for j, i in enumerate(ids)}
        roots.append(at[1])
        for i in ids:
            inner = i in splits
            feature, cut = splits.get(i, (-1, 0))
            columns["feature"].append(feature)
            columns["threshold"].append(cuts[feature][cut] if inner else 0.0)
            columns["left"].append(at[2 * i] if inner else 0)
            columns["right"].append(at[2 * i + 1] if inner else 0)
            columns["value"].append(0.0 if inner else value[i])
            columns["gain"].append(gains.get(i, 0.0))
    return FlatTrees(np.array(roots), *(np.array(columns[k]) for k in columns), base=base)
