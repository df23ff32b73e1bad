from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glycospan.llm import hard_negatives, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 12))
    out = []
    for i in range(700):
        v = centres[rng.integers(0, 6)] + rng.normal(0, 0.6, 12)
        out.append((i, [float(np.float32(c)) for c in v / np.linalg.norm(v)], int(rng.integers(0, 4))))
    for i in range(700, 940):  # one vector holds a quarter of all rows
        out.append((i, out[5][1], 1))
    out += [
        (940, None, 1),
        (941, [0.1] * 11 + [None], 1),
        (942, [0.1] * 11 + [float("nan")], 2),
        (943, [0.1] * 11 + [float("inf")], 2),
        (944, [0.2] * 12, None),
        (None, [0.3] * 12, 1),
        out[7],  # the same row again
        (950, [-c for c in out[3][1]], 3),
    ]
    return out


def test_packed_rows_come_back_in_the_narrowest_width():
    whole = np.array([[1, -2], [200, 3], [-40_000, 0], [1 << 40, 5], [1, -2]])
    codes = {}
    for found, data in vectors.packed(whole):
        for i, b in zip(found.tolist(), data.to_pylist(), strict=True):
            codes[i] = b
    assert codes[0] == codes[4] and [len(codes[i]) for i in range(4)] == [3, 5, 9, 17]
    for found, matrix in vectors.unpacked(pa.array([codes[i] for i in range(5)])):
        np.testing.assert_array_equal(matrix, whole[found])
    assert [m.shape for _, m in vectors.unpacked(pa.array([b"\x00", b"\x00"]))] == [(2, 0)]


def test_finite_vectors_by_length():
    column = pa.array([[1.0, 2.0], None, [3.0, None], [], [math.inf, 1.0], [5.0], [7.0, 8.0]], pa.list_(pa.float64()))
    got = {m.shape[1]: (r.tolist(), m.tolist()) for r, m in vectors.finite(column.slice(0))}
    assert got == {0: ([3], [[]]), 1: ([5], [[5.0]]), 2: ([0, 6], [[1.0, 2.0], [7.0, 8.0]])}
    assert [r.tolist() for r, _ in vectors.finite(column.slice(4))] == [[1], [2]]


# --- whitening -----------------------------------------------------------------


def whitened(rows):
    """The definition, with exact whole numbers and one dense covariance."""
    kept = [(i, np.floor(64 * np.array(v, float)).astype(int) + 1_000_000) for i, v, *_ in rows if usable(v) and len(v) == 12]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    out = {}
    for i, x in kept:
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, total))
        out.setdefault(i, []).append((deviation, (x - total / n) @ directions[:, order] / np.sqrt(values[order])))
    return n, values[order] / values.sum(), out


def test_whitening_is_the_definition(spark, rows):
    n, shares, want = whitened(rows)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 12 * sum(len(v) for v in want.values())
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    sign = {}
    for r in got:
        deviation, z = want[r.vec_id][0]
        assert r.deviation == deviation
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        z = z[r.component - 1]
        s = sign.setdefault(r.component, np.sign(z * r.whitened) or 1.0) if abs(z) > 1e-6 else sign.get(r.component, 1.0)
        assert s * r.whitened == pytest.approx(z, abs=1e-8)


def test_squares_of_sums_give_every_covariance():
    rng = np.random.default_rng(6)
    for y in (rng.integers(-90, 90, (9000, 5)), rng.integers(-(1 << 50), 1 << 50, (50, 3))):
        sums = dict(zip(whitening.pairs(y.shape[1]), whitening.square_sums(y), strict=True))
        big = y.astype(object)
        assert all(v == sum((big[:, i] + (big[:, j] if i != j else 0)) ** 2) for (i, j), v in sums.items())
        got = whitening.covariance(len(y), [int(v) for v in big.sum(axis=0)], sums)
        np.testing.assert_allclose(got, np.cov(y.astype(float).T, bias=True), rtol=1e-9, atol=1e-9 * np.abs(got).max())


def test_deviations_stay_exact_when_numbers_are_large():
    model = whitening.Whitening(10**6, [0, 3], [499_999, -5], np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    y = np.array([[1, -2], [1 << 20, 7], [1 << 45, 0]])
    want = [sum((10**6 * int(a) - r) ** 2 for a, r in zip(row, [499_999, -5])) for row in y]
    assert model.deviations(y) == [v if v < 1 << 63 else None for v in want]


def test_whitening_of_odd_tables(spark):
    nothing = frame(spark, [], parts=1)
    assert whitening.whiten(nothing).count() == 0
    same = frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])
    assert whitening.whiten(same).count() == 0  # no variance, no component
    rows = [(1, [1.0, 2.0, 5.0], 0), (2, [2.0, 2.0, 5.0], 0), (3, [4.0, 2.0, 5.0], 0), (4, [1.0], 0), (5, [], 0), (None, [0.0, 2.0, 5.0], 0)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "2", "3", "None"] and {r.component for r in got} == {1}
    assert {round(r.explained, 9) for r in got} == {1.0}
    clashing = spark.createDataFrame([(7, [1.0, 0.0], "a", 1.0), (8, [0.0, 3.0], "b", 2.0)], "key long, v array<double>, vec_id string, vector double")
    assert {r.vec_id for r in whitening.whiten(clashing, "key", "v").collect()} == {7, 8}
    huge = frame(spark, [(1, [1e30, 0.0], 0), (2, [-1e30, 1.0], 0), (3, [0.0, 2.0], 0)])
    assert whitening.whiten(huge).where("component = 1").count() == 3


# --- hard negatives --------------------------------------------------------------


def mined(rows, every=50, positives=5, negatives=3):
    by_id = {}
    for i, v, label in rows:
        if i is not None and label is not None and usable(v):
            row = (label, tuple(int(c) for c in np.floor(256 * np.array(v, float))))
            by_id[i] = min(by_id.get(i, row), row)
    out = []
    for a, (label, x) in by_id.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in by_id.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            window = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(window, 1)]
    return sorted(out)


def test_hard_negatives_are_brute_force(spark, rows):
    df = frame(spark, rows)
    assert sorted(map(tuple, hard_negatives.mine(df).collect())) == mined(rows)
    got = hard_negatives.mine(df, F.col("vec_id") % 9 == 0, positives=3, negatives=2)
    assert sorted(map(tuple, got.collect())) == mined(rows, 9, 3, 2)


def test_small_seeds_blocks_and_batches_change_nothing(spark, rows, monkeypatch):
    """Few seeds give no thresholds or bad ones, and several rounds are needed."""
    want = mined(rows, 5)
    for seeds, anchors, pairs in ((1, 40, 500), (12, 1000, 100_000)):
        monkeypatch.setattr(hard_negatives, "SEEDS", seeds)
        monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
        monkeypatch.setattr(hard_negatives, "PAIRS", pairs)
        assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows, parts=7), F.col("vec_id") % 5 == 0).collect())) == want


@pytest.mark.parametrize("size", [1, 1000, 1 << 24])
def test_joins_above_a_threshold_are_exact(size):
    rng = np.random.default_rng(size)
    for d in (1, 8, 19):
        q, r = rng.integers(-size, size + 1, (40, d)), rng.integers(-size, size + 1, (300, d))
        r[:50] //= 7  # short rows are indexed in few blocks
        scores = q @ r.T
        for quantile in (0.0, 0.5, 0.9, 0.999):
            least = np.quantile(scores, quantile, axis=1).astype(np.int64)
            i, j, s = hard_negatives.scores_above(q, r, least)
            assert sorted(zip(i.tolist(), j.tolist(), s.tolist())) == [(a, b, scores[a, b]) for a, b in np.argwhere(scores >= least[:, None]).tolist()]


def test_rows_are_left_out_of_the_index_and_pairs_pruned():
    rng = np.random.default_rng(8)
    q, r = rng.integers(-100, 100, (20, 64)), rng.integers(-100, 100, (500, 64))
    r[:, 16:] //= 50
    assert (hard_negatives.suffix_norms(r)[:, 2] * np.linalg.norm(q, axis=1).max() < 20_000).all()  # two of eight blocks are indexed
    i, j, s = hard_negatives.scores_above(q, r, np.full(20, 20_000))
    assert len(i) == ((q @ r.T) >= 20_000).sum() > 0


def test_ties_zero_scores_and_odd_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, -1.0], 2), (3, [0.0, 0.5], 2), (4, [0.0, 0.25], 2), (50, [1.0, 1.0], 3), (100, [-1.0, 0.0], 1), (6, [], 2), (7, [1e20, 0.0], 5)]
    got = sorted(map(tuple, hard_negatives.mine(frame(spark, rows)).collect()))
    capped = [(i, [min(c, float(1 << 17)) for c in v] + [0.0] * (2 - len(v)), y) for i, v, y in rows]
    assert got == mined(capped)
    assert any(r[4] == 0 for r in got)  # a positive with score 0 takes negatives with score 0
    assert hard_negatives.mine(frame(spark, [], parts=1)).count() == 0
    assert hard_negatives.mine(frame(spark, [(50, [1.0], None), (100, None, 1)])).count() == 0
    clashing = spark.createDataFrame([(0, [1.0], 1, 9), (1, [1.0], 1, 9), (2, [0.9], 2, 9)], "key long, v array<double>, kind int, vec_id int")
    assert [tuple(r) for r in hard_negatives.mine(clashing, id_col="key", label_col="kind", vector_col="v").collect()] == [(0, 1, 1, 2, 65536, 256 * 230)]


def test_repeated_ids_keep_the_least_row(spark):
    rng = random.Random(1)
    rows = [(i % 60, [rng.uniform(-1, 1) for _ in range(4)], rng.randint(0, 2)) for i in range(150)]
    rows = [(i, [float(np.float32(c)) for c in v], y) for i, v, y in rows]
    assert len({r[0] for r in mined(rows, 10)}) > 0
    got = sorted(map(tuple, hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    once = hard_negatives.mine(frame(spark, rows + rows, parts=5), F.col("vec_id") % 10 == 0)
    assert got == sorted(map(tuple, once.collect()))
