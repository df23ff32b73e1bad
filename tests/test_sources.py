import math
import uuid

import pytest
from pyspark.sql import functions as F

from glycospan.sources import profile, sinks
from glycospan.sources.readings import READINGS, as_readings, read_readings, scan
from glycospan.sources.sinks import write_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, 1, None, math.nan, None), (2, 1, None, 5.0, None)], READINGS)
    assert [r.value for r in as_readings(df).orderBy("id").collect()] == [None, 5.0]


def test_missing_actual_time_is_added(make):
    assert as_readings(make([(1, 0, 100)]).drop("actual_time")).schema == READINGS


def test_patient_filter_reaches_the_scan(spark, make, tmp_path):
    path = str(tmp_path / "r")
    make([(p, m, 100 + m) for p in (1, 2, 3) for m in range(5)]).write.parquet(path)
    one = scan(read_readings(spark, path), 2)
    assert one.count() == 5
    plan = _plan(one)
    assert "PushedFilters" in plan and "EqualTo(patient_id,2)" in plan
    assert scan(read_readings(spark, path), [1, 3]).count() == 10


def test_scan_reads_needed_columns_only(spark, make, tmp_path):
    path = str(tmp_path / "r")
    make([(1, m, 100 + m) for m in range(5)]).write.parquet(path)
    plan = _plan(profile.load_summary(read_readings(spark, path)))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "actual_time" not in schema and "id:bigint,p" not in schema.replace("patient_", "")


def test_csv_round_trip(spark, make, tmp_path):
    rows = make([(p, m * 7, 90.5 + m) for p in (1, 2) for m in range(20)])
    path = str(tmp_path / "csv")
    write_table(rows, path, order=("timestamp",))
    back = read_readings(spark, path, "csv", header=True)
    # the patient is the folder name, so columns inside the files are the others
    files = spark.read.option("header", True).csv(path)
    assert set(files.columns) == set(rows.columns)
    assert files.count() == 40
    got = as_readings(files).orderBy("id").collect()
    assert got == rows.orderBy("id").collect()
    assert back.columns == READINGS.names


def test_parquet_sink_without_patient_folders(spark, make, tmp_path):
    path = str(tmp_path / "pq")
    rows = make([(1, m, 100) for m in range(3)])
    write_table(rows, path, "parquet", by_patient=False)
    assert read_readings(spark, path).count() == 3
    with pytest.raises(Exception):
        write_table(rows, path, "parquet")


def test_preview_orders_by_time_then_id(make):
    rows = make([(1, 5, 1), (1, 0, 2), (2, 0, 3), (1, 9, 4)])
    assert [r.id for r in profile.preview(rows, 3).collect()] == [1, 2, 0]
    assert "WindowGroupLimit" in _plan(profile.preview_per_patient(rows, 1))
    per = profile.preview_per_patient(rows, 1).orderBy("patient_id").collect()
    assert [r.id for r in per] == [1, 2]


def test_column_profile(make):
    got = {
        r.column_name: r
        for r in profile.column_profile(make([(1, 0, 5), (1, 1, None), (2, 2, 5)])).collect()
    }
    assert (got["value"].non_null, got["value"].nulls, got["value"].distinct_values) == (2, 1, 1)
    assert (got["actual_time"].nulls, got["actual_time"].distinct_values) == (3, 0)
    assert got["patient_id"].data_type == "bigint"


def test_sketched_profile_agrees_on_few_values(make):
    rows = make([(1, 0, 5), (1, 1, None), (2, 2, 5)])
    exact, close = profile.column_profile(rows), profile.column_profile(rows, approx=True)
    assert close.columns == exact.columns
    assert sorted(close.collect()) == sorted(exact.collect())


def test_column_profile_of_no_rows(make):
    got = profile.column_profile(make([(1, 0, 5)]).where(F.lit(False))).collect()
    assert all((r.non_null, r.nulls, r.distinct_values) == (0, 0, 0) for r in got)


def test_whole_days(make):
    summary = profile.view_summary(make([(1, 0, 5), (1, 2 * 1440 + 1439, 9)]), "raw").first()
    assert summary.duration_days == 2 and summary.n_rows == 2


def test_a_bucketed_table_spares_exchanges_by_patient(spark, waves):
    from glycospan.operators import features, patterns

    table = f"grid_{uuid.uuid4().hex}"
    sinks.write_bucketed(waves, table, 3)
    try:
        back = spark.table(table)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, waves.collect()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for made in (features.add_lags(back), patterns.histogram(back), patterns.box_plot(back), patterns.variability(back)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
        assert "Exchange" in features.add_lags(waves)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {table}")


def test_only_the_days_of_a_rerun_are_replaced(spark, make, tmp_path):
    day = 24 * 60
    sinks.replace_days(make([(1, 5, 100), (1, day + 5, 110), (2, day + 9, 120)]), str(tmp_path / "days"))
    sinks.replace_days(make([(1, day + 7, 90)]), str(tmp_path / "days"))
    got = spark.read.parquet(str(tmp_path / "days")).orderBy("timestamp").collect()
    assert [(r.patient_id, r.value) for r in got] == [(1, 100.0), (1, 90.0)]
