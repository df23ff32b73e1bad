from pyspark.sql import functions as F

from glycospan.plans.analysis import analyse
from glycospan.plans.comparison import compare
from oracle.registry import readings


def test_full_analysis(spark, sf_dir):
    study = analyse(readings(spark, sf_dir))
    assert study.flagged.count() == study.readings.count()
    tables = study.patterns()
    assert {n for n, t in tables.items() if t.count() == 0} == set()
    forecast = study.forecast(48)
    assert forecast.where("is_future").count() == 48 * study.hourly.select("patient_id").distinct().count()
    rows = study.report(forecast)
    assert rows.count() == 7 * study.hourly.select("patient_id").distinct().count()
    noisy = study.forecast(48, noise=0.2, seed=1)
    assert noisy.where("is_future and not predicted_glucose between 40 and 400").count() == 0


def test_analysis_with_a_regressor(spark):
    study = analyse(readings(spark, "/root/testdata/sf0.01"))
    forecast = study.forecast(24, "ridge", scope="patient", mode="recursive", noise=0.1)
    assert forecast.where("is_future").count() == 48
    daily = study.forecast(3, "decision_tree", freq="D", depth=3)
    assert daily.where("is_future").groupBy("patient_id").agg(F.count("*").alias("n")).where("n = 3").count() == 2


def test_comparison(spark):
    board, counts = compare(readings(spark, "/root/testdata/sf0.01"), ("prophet", "ridge", "knn"))
    assert board.count() == 6 and counts.count() == 2


def test_no_readings(spark, sf_dir):
    study = analyse(readings(spark, sf_dir).where("id < 0"))
    assert study.flagged.count() == 0 and study.hourly.count() == 0
    assert study.forecast(24).count() == 0
