import datetime as dt

import numpy as np
import pandas as pd
import pytest

from glycospan.config import Settings
from glycospan.operators import anomalies
from glycospan.operators.slices import slice_readings
from tests.conftest import START


def flags(make, rows, settings=Settings()):
    out = anomalies.flag_anomalies(make(rows), settings).orderBy("id").collect()
    return out


def test_equal_times_with_different_values_are_a_sudden_change(make):
    rows = flags(make, [(1, 0, 100), (1, 0, 130)])
    assert [r.sudden_change for r in rows] == [False, True]


def test_equal_times_with_equal_values_are_not(make):
    assert not any(r.sudden_change for r in flags(make, [(1, 0, 100), (1, 0, 100)]))


def test_constant_series_has_no_outlier(make):
    assert not any(r.statistical_outlier for r in flags(make, [(1, m, 100.1) for m in range(50)]))


def test_single_reading(make):
    row = flags(make, [(1, 0, 100)])[0]
    assert row.glucose_diff is None and row.time_diff is None and not row.anomaly
    assert row.anomaly_type == ""


def test_null_in_the_middle(make):
    rows = flags(make, [(1, 0, 100), (1, 5, None), (1, 10, 110)])
    assert [r.glucose_diff for r in rows] == [None, None, None]
    assert [r.time_diff for r in rows] == [None, 5.0, 5.0]


def test_limits_of_the_valid_range(make):
    rows = flags(make, [(1, 0, 39.9), (1, 60, 40), (1, 120, 400), (1, 180, 400.1)])
    assert [r.sensor_error for r in rows] == [True, False, False, True]


def test_three_labels_at_once(make):
    rows = flags(make, [(1, 2 * i, 100) for i in range(20)] + [(1, 40, 450)])
    assert rows[-1].anomaly_type == "sensor_error,statistical_outlier,sudden_change,"


def test_gap_is_not_part_of_all(make):
    flagged = anomalies.flag_anomalies(make([(1, 0, 100), (1, 15, 100), (1, 31, 100)]))
    gaps = anomalies.anomaly_subset(flagged, "data_gaps").collect()
    assert [r.gap_duration for r in gaps] == [16.0]
    assert anomalies.anomaly_subset(flagged, "all").count() == 0


def test_unknown_subset(make):
    with pytest.raises(ValueError):
        anomalies.anomaly_subset(anomalies.flag_anomalies(make([(1, 0, 1)])), "nope")


def test_label_array(make):
    flagged = anomalies.flag_anomalies(make([(1, 0, 100), (1, 1, 500)]))
    labels = anomalies.label_array(flagged).orderBy("id").collect()
    assert [r.anomaly_types for r in labels] == [[], ["sensor_error", "sudden_change"]]


def _brute_force(pdf):
    out = []
    for _, g in pdf.groupby("patient_id"):
        g = g.sort_values(["timestamp", "id"]).copy()
        g["glucose_diff"] = g["value"].diff()
        g["time_diff"] = g["timestamp"].diff().dt.total_seconds() / 60
        with np.errstate(all="ignore"):
            rate = g["glucose_diff"] / g["time_diff"]
            g["sudden_change"] = rate.abs() > 5
            z = (g["value"] - g["value"].mean()).abs() / g["value"].std(ddof=0)
        g["statistical_outlier"] = z > 3
        g["data_gap"] = g["time_diff"] > 15
        out.append(g)
    return pd.concat(out).sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize(
    "settings",
    [
        Settings(),
        Settings(max_slice_rows=20),  # many days are too full
        Settings(max_slice_rows=3, slice_hours=1),
        Settings(max_slice_rows=1, broadcast_rows=40),  # the limit follows the broadcast size
    ],
)
def test_slices_give_the_rows_of_one_window(spark, settings):
    """One patient with most rows, one hour with most of its rows, many equal times."""
    rng = np.random.default_rng(5)
    n = 900
    patient = np.where(rng.random(n) < 0.7, 1, rng.integers(2, 5, n))
    minutes = np.where(rng.random(n) < 0.5, rng.integers(0, 3, n), rng.integers(0, 6000, n))
    value = np.round(rng.normal(140, 40, n), 1)
    value[rng.random(n) < 0.03] = np.nan
    value[5] = 399.0
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "patient_id": patient,
            "timestamp": [START + dt.timedelta(minutes=int(m)) for m in minutes],
            "value": value,
        }
    )
    from glycospan.sources.readings import as_readings

    rows = as_readings(spark.createDataFrame(pdf))
    got = anomalies.flag_anomalies(rows, settings).toPandas().sort_values("id").reset_index(drop=True)
    want = _brute_force(pdf)
    assert len(got) == n
    for column in ("sudden_change", "statistical_outlier", "data_gap"):
        assert (got[column].to_numpy() == want[column].to_numpy()).all(), column
    for column in ("glucose_diff", "time_diff"):
        np.testing.assert_allclose(got[column].to_numpy(float), want[column].to_numpy(float))


def test_full_days_are_cut(spark, make):
    rows = make([(1, m % 50, 100 + m % 7) for m in range(200)])
    sliced, summary = slice_readings(rows, Settings(max_slice_rows=30))
    assert sliced.count() == 200
    assert summary.selectExpr("sum(n_rows)").first()[0] == 200
    assert sliced.select("part").distinct().count() > 2


def test_small_parts_need_no_task_each(spark, make):
    rows = make([(1 + m % 3, m % 50, 100 + m % 7) for m in range(600)])
    sliced, summary = slice_readings(rows, Settings(max_slice_rows=2))
    assert summary.selectExpr("max(n_rows)").first()[0] <= 2
    assert sliced.count() == 600
    assert sliced.rdd.getNumPartitions() < 40


def test_readings_without_time_are_kept(spark):
    from glycospan.sources.readings import READINGS

    rows = spark.createDataFrame(
        [(1, 1, None, 100.0, None), (2, 1, START, 500.0, None)], READINGS
    )
    got = anomalies.flag_anomalies(rows).orderBy("id").collect()
    assert [r.sensor_error for r in got] == [False, True]
