import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from glycospan.config import Settings
from glycospan.functions.quantiles import exact_quantiles
from glycospan.operators import cleaning
from glycospan.operators.attach import attach
from glycospan.sources.readings import as_readings
from tests.conftest import START


def test_validity_filter(make):
    rows = make([(1, 0, 39.9), (1, 1, 40), (1, 2, 400), (1, 3, 400.1), (1, 4, None)])
    assert [r.value for r in cleaning.valid_readings(rows).orderBy("id").collect()] == [40, 400]
    counts = cleaning.removed_counts(rows).first()
    assert (counts.records, counts.kept, counts.removed) == (5, 2, 3)


def test_bins_of_a_gap(make):
    """30 empty hours: the first 24 are filled, the other 6 are not."""
    grid = cleaning.resample(make([(1, 0, 100), (1, 31 * 60, 131)]), fill_limit=24)
    rows = grid.orderBy("hour_ts").collect()
    assert len(rows) == 32
    assert [r.glucose for r in rows[:25]] == pytest.approx([100 + i for i in range(25)])
    assert [r.glucose for r in rows[25:31]] == [None] * 6
    assert rows[31].glucose == 131
    assert [r.reading_count for r in rows] == [1] + [0] * 30 + [1]
    assert rows[1].glucose_min is None and rows[0].glucose_std is None


def test_gap_of_exactly_the_limit(make):
    rows = cleaning.resample(make([(1, 0, 100), (1, 25 * 60, 125)]), fill_limit=24).collect()
    assert all(r.glucose is not None for r in rows)


def test_whole_gaps_only(make):
    long_gap = make([(1, 0, 100), (1, 26 * 60, 126)])
    rows = cleaning.resample(long_gap, fill_limit=24, whole_gaps_only=True).collect()
    assert sum(r.glucose is None for r in rows) == 25


def test_very_long_gap_has_every_hour(make):
    rows = cleaning.resample(make([(1, 0, 100), (1, 5000 * 60, 126)]))
    got = rows.agg(F.count("*"), F.count_distinct("hour_ts")).first()
    assert tuple(got) == (5001, 5001)


@pytest.mark.parametrize("interval", ["H", "D", "W"])
def test_bins_match_pandas(spark, interval):
    rng = np.random.default_rng(1)
    n = 300
    stamps = [START + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 60 * 24 * 40, n)]
    pdf = pd.DataFrame(
        {"id": range(n), "patient_id": 1, "timestamp": stamps, "value": rng.normal(120, 30, n)}
    )
    want = pdf.set_index("timestamp")["value"].resample(interval.lower() if interval == "H" else interval)
    want = want.agg(["mean", "std", "min", "max", "count"])
    want["mean"] = want["mean"].interpolate(method="time", limit=24)
    got = cleaning.resample(as_readings(spark.createDataFrame(pdf)), interval, 24).toPandas()
    got = got.sort_values("hour_ts").set_index("hour_ts")
    assert list(got.index) == list(want.index)
    for ours, theirs in zip(
        ("glucose", "glucose_std", "glucose_min", "glucose_max", "reading_count"), want.columns
    ):
        np.testing.assert_allclose(got[ours].to_numpy(float), want[theirs].to_numpy(float))


def test_unknown_interval(make):
    with pytest.raises(KeyError):
        cleaning.resample(make([(1, 0, 1)]), "M")


@pytest.mark.parametrize(
    "settings",
    [
        Settings(),
        Settings(max_slice_rows=5, quantile_bins=4),  # bins are refined several times
        Settings(max_slice_rows=5, quantile_bins=16, broadcast_rows=0),  # bins are not broadcast
    ],
)
def test_exact_quantiles(spark, settings):
    rng = np.random.default_rng(2)
    values = {
        1: np.r_[rng.uniform(40, 400, 300), np.full(200, 123.4)],
        2: np.array([100.0]),
        3: np.r_[np.full(50, 40.0), np.full(50, 400.0)],
        4: rng.normal(120, 1e-4, 200),
    }
    rows = spark.createDataFrame(
        [(p, float(v)) for p, vs in values.items() for v in vs], "patient_id long, value double"
    )
    probs = {"a": 0.01, "b": 0.5, "c": 0.99}
    table, at_most = exact_quantiles(rows, "value", probs, 40.0, 400.0, settings)
    got = {r.patient_id: r for r in table.collect()}
    assert len(got) == 4 <= at_most
    for p, vs in values.items():
        for name, q in probs.items():
            assert got[p][name] == pytest.approx(np.quantile(vs, q), abs=1e-12)


def test_winsorize_by_shuffle(make):
    """More patients than may be broadcast, one of them with most rows."""
    rows = make([(p, m, 60 + (m * 7) % 200) for p in (1, 2, 3) for m in range(150 if p == 1 else 9)])
    want = cleaning.winsorize(cleaning.valid_readings(rows)).collect()
    got = cleaning.winsorize(
        cleaning.valid_readings(rows), Settings(broadcast_rows=4, max_slice_rows=20)
    ).collect()
    assert sorted(got, key=lambda r: r.id) == sorted(want, key=lambda r: r.id)


def test_winsorize_clips_to_the_quantiles(make):
    values = list(range(50, 151))
    rows = make([(1, i, v) for i, v in enumerate(values)])
    got = cleaning.winsorize(rows).agg(F.min("value"), F.max("value"), F.count("*")).first()
    assert tuple(got) == (51.0, 149.0, 101)
    close = cleaning.winsorize(rows, approx=True).agg(F.min("value"), F.max("value")).first()
    assert close[0] == pytest.approx(51, abs=1.5) and close[1] == pytest.approx(149, abs=1.5)


def test_attach_by_shuffle_equals_broadcast(spark, make):
    rows = make([(p, m, 100 + m) for p in (1, 1, 1, 2) for m in range(30)])
    table = spark.createDataFrame(
        [(1, 90, 0.5), (3, 0, 0.7)], "patient_id long, total long, extra double"
    )
    small = attach(rows, table, 2, F.col("id"), Settings())
    large = attach(rows, table, 200, F.col("id"), Settings(broadcast_rows=100, max_slice_rows=7))
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan
    assert small.columns == large.columns
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)


@hyp(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.integers(0, 90), st.integers(40, 400)), min_size=1, max_size=12, unique_by=lambda x: x[0]
    )
)
def test_interpolation_property(make, points):
    """Against a direct per-hour loop."""
    grid = cleaning.resample(make([(1, h * 60, v) for h, v in points]), fill_limit=24)
    got = [r.glucose for r in grid.orderBy("hour_ts").collect()]
    known = dict(points)
    first, last = min(known), max(known)
    for h in range(first, last + 1):
        left = max(k for k in known if k <= h)
        right = min(k for k in known if k >= h)
        if h == left:
            want = known[h]
        elif h - left <= 24:
            want = known[left] + (known[right] - known[left]) * (h - left) / (right - left)
        else:
            want = None
        assert got[h - first] == (want if want is None else pytest.approx(want))
