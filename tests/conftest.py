from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from glycospan.session import get_session

    session = get_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def make(spark):
    """Readings from (patient, minutes since 2024-01-01, value) triples, ids in order."""
    from glycospan.sources.readings import READINGS

    def build(rows):
        return spark.createDataFrame(
            [
                (i, p, START + dt.timedelta(minutes=m), None if v is None else float(v), None)
                for i, (p, m, v) in enumerate(rows)
            ],
            READINGS,
        )

    return build


@pytest.fixture(scope="session")
def make_hourly(spark):
    """Hourly grid from (patient, hours since 2024-01-01, glucose) triples."""
    def build(rows):
        return spark.createDataFrame(
            [
                (
                    p,
                    START + dt.timedelta(hours=h),
                    None if v is None else float(v),
                    1.0,
                    None if v is None else float(v),
                    None if v is None else float(v),
                    3,
                )
                for p, h, v in rows
            ],
            "patient_id long, hour_ts timestamp, glucose double, glucose_std double, "
            "glucose_min double, glucose_max double, reading_count long",
        )

    return build


@pytest.fixture(scope="session")
def waves(make_hourly):
    """Two patients, 40 days: two meals a day over a level that drifts, with noise."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for p, level in ((1, 115.0), (2, 150.0)):
        for h in range(40 * 24):
            hour = h % 24
            meals = 40 * np.exp(-(((hour - 8) / 2) ** 2)) + 30 * np.exp(-(((hour - 19) / 2.5) ** 2))
            rows.append((p, h, level + meals + 0.02 * h + rng.normal(0, 6)))
    return make_hourly(rows).persist()
