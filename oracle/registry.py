"""Every registered query with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glycospan.config import Settings
from glycospan.functions import ranges
from glycospan.operators import anomalies, cleaning, evaluation, features, forecasting
from glycospan.operators import models, patterns, report, seasonal, seasonal_map
from glycospan.session import durable, durable_path, use_utc
from glycospan.sources import profile, sinks
from glycospan.sources.readings import as_readings, scan
from oracle import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

def settle(df: DataFrame) -> DataFrame:
    """Zone-free timestamps, and doubles cut to 1e-6 as the check SQL does."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.floor(c * F.lit(1e6) + F.lit(0.41421356)) / F.lit(1e6)
        columns.append(c.alias(f.name))
    return df.select(columns)


def check(name: str, sql: str | None = None, doubles: str = ""):
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return settle(function(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = S.settled(sql, doubles)
        return function

    return register


# --- inputs ------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sensor readings of busy patients: 75 users in a row are one patient.

    A patient has about 5,000 readings, enough for hourly data. All events are kept.
    """
    return as_readings(
        spark.sql(
            """SELECT event_id AS id,
                      user_id div 75 AS patient_id,
                      ts AS timestamp, 38 + 1.2D * value AS value
               FROM {events}""",
            events=_events(spark, sf_dir),
        )
    )


def user_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of one patient per user: sparse, with long gaps."""
    return as_readings(
        _events(spark, sf_dir).selectExpr(
            "event_id AS id", "user_id AS patient_id", "ts AS timestamp", "38 + 1.2D * value AS value"
        )
    )


def flagged(spark, d):
    return anomalies.flag_anomalies(readings(spark, d))


def hourly(spark, d):
    return cleaning.clean(readings(spark, d))


def feature_table(spark, d, leak_free: bool = False):
    return features.build_features(hourly(spark, d), leak_free)


def kept_hourly(spark, d):
    """The grid as a written table, for queries that read it in several branches."""
    return durable(hourly(spark, d))


def kept_features(spark, d, leak_free: bool = False):
    return durable(feature_table(spark, d, leak_free))


def _seasonal(spark, d, periods: int = 168):
    """History and forecast of the seasonal model with the step of future rows."""
    history = kept_hourly(spark, d)
    grid = forecasting.future_grid(history, periods)
    model = seasonal.fit_seasonal_trend(history)
    return forecasting.seasonal_forecast(model, history, grid)


def _ahead(spark, d, periods: int = 168):
    return forecasting.future_only(_seasonal(spark, d, periods))


READ, USERS = S.READINGS, S.USER_READINGS
T_READ = S.with_tables(READ)
T_FLAG = S.with_tables(READ, S.FLAGGED)
T_CLIP = S.with_tables(READ, S.CLIPPED)
T_HOUR = S.with_tables(READ, S.HOURLY)
T_FEAT = S.with_tables(READ, S.features())
T_CAST = S.with_tables(READ, S.forecast(168))

# --- scans and summaries -------------------------------------------------------


@check(
    "s1_patient_scan",
    T_READ + 'SELECT id, patient_id, "timestamp", value, actual_time FROM readings',
    "value",
)
def _(spark, d):
    return scan(readings(spark, d))


STATS = """SELECT patient_id, count(*) AS total_records, min("timestamp") AS earliest_date,
  max("timestamp") AS latest_date, avg(value) AS avg_glucose, min(value) AS min_glucose,
  max(value) AS max_glucose, stddev_pop(value) AS std_glucose FROM readings GROUP BY patient_id"""


@check("s2_table_statistics", T_READ + STATS, "avg_glucose min_glucose max_glucose std_glucose")
def _(spark, d):
    return profile.table_statistics(readings(spark, d))


PROFILED = [("id", "bigint"), ("patient_id", "bigint"), ("timestamp", "timestamp"),
            ("value", "double"), ("actual_time", "timestamp")]


@check(
    "s3_column_profile",
    T_READ
    + " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{t}' AS data_type,
            true AS nullable, count("{c}") AS non_null, count(*) - count("{c}") AS nulls,
            count(DISTINCT "{c}") AS distinct_values FROM readings"""
        for i, (c, t) in enumerate(PROFILED)
    ),
)
def _(spark, d):
    return profile.column_profile(readings(spark, d))


@check(
    "s4_preview",
    T_READ + 'SELECT id, patient_id, "timestamp", value FROM readings ORDER BY "timestamp", id LIMIT 10',
    "value",
)
def _(spark, d):
    return profile.preview(readings(spark, d)).drop("actual_time")


@check(
    "s4_preview_per_patient",
    S.with_tables(USERS)
    + """SELECT * FROM (SELECT id, patient_id, "timestamp", value,
         CAST(row_number() OVER (PARTITION BY patient_id ORDER BY "timestamp", id) AS INTEGER) AS position
         FROM readings) WHERE position <= 10""",
    "value",
)
def _(spark, d):
    return profile.preview_per_patient(user_readings(spark, d)).drop("actual_time")


@check(
    "s5_timestamp_coercion",
    """SELECT event_id AS id, user_id AS patient_id, ts AS "timestamp", value,
       CASE WHEN event_type = 'view' THEN ts END AS actual_time FROM events""",
    "value",
)
def _(spark, d):
    text = _events(spark, d).selectExpr(
        "CAST(event_id AS STRING) AS id",
        "CAST(user_id AS INT) AS patient_id",
        "CAST(ts AS STRING) AS timestamp",
        "CAST(value AS STRING) AS value",
        "CASE WHEN event_type = 'view' THEN CAST(ts AS STRING) END AS actual_time",
    )
    return as_readings(text)


@check(
    "s6_load_summary",
    T_READ
    + """SELECT patient_id, count(*) AS records, min("timestamp") AS first_reading,
         max("timestamp") AS last_reading, min(value) AS lowest, max(value) AS highest
         FROM readings GROUP BY patient_id""",
    "lowest highest",
)
def _(spark, d):
    return profile.load_summary(readings(spark, d))


@check(
    "s7_sink_round_trip",
    T_READ + """SELECT id, patient_id, "timestamp", value FROM readings""",
    "value",
)
def _(spark, d):
    """Readings written with a folder for each patient and read back."""
    path = f"{durable_path(spark)}/readings"
    sinks.write_table(readings(spark, d), path, "parquet")
    back = spark.read.parquet(path)
    return back.select("id", F.col("patient_id").cast("long"), "timestamp", "value")


def _days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 8.64e10) AS BIGINT)"


def _view_sql(view: str, table: str, ts: str, value: str) -> str:
    return f"""SELECT patient_id, min({ts}) AS from_time, max({ts}) AS to_time, count(*) AS n_rows,
      min({value}) AS min_value, max({value}) AS max_value,
      {_days(f"max({ts})", f"min({ts})")} AS duration_days, '{view}' AS data_view
      FROM {table} GROUP BY patient_id"""


@check(
    "s8_view_summary_raw",
    T_READ + _view_sql("raw", "readings", '"timestamp"', "value"),
    "min_value max_value",
)
def _(spark, d):
    return profile.view_summary(readings(spark, d), "raw")


@check(
    "s8_view_summary_cleaned",
    T_HOUR + _view_sql("cleaned", "hourly", "hour_ts", "glucose"),
    "min_value max_value",
)
def _(spark, d):
    return profile.view_summary(hourly(spark, d), "cleaned")


# --- anomalies -----------------------------------------------------------------


@check(
    "q1_sensor_errors",
    T_READ
    + """SELECT id, patient_id, "timestamp", value,
         coalesce(value < 40 OR value > 400, false) AS sensor_error FROM readings""",
    "value",
)
def _(spark, d):
    return anomalies.sensor_errors(readings(spark, d)).drop("actual_time")


@check(
    "q2_statistical_outliers",
    T_FLAG + "SELECT id, patient_id, value, statistical_outlier FROM flagged",
    "value",
)
def _(spark, d):
    return flagged(spark, d).select("id", "patient_id", "value", "statistical_outlier")


@check(
    "q3_deltas",
    T_FLAG + "SELECT id, patient_id, glucose_diff, time_diff, rate_of_change FROM flagged",
    "glucose_diff time_diff rate_of_change",
)
def _(spark, d):
    return flagged(spark, d).select(
        "id", "patient_id", "glucose_diff", "time_diff", "rate_of_change"
    )


@check(
    "q3_deltas_per_user",
    S.with_tables(USERS, S.FLAGGED)
    + "SELECT id, patient_id, glucose_diff, time_diff, rate_of_change FROM flagged",
    "glucose_diff time_diff rate_of_change",
)
def _(spark, d):
    return anomalies.flag_anomalies(user_readings(spark, d)).select(
        "id", "patient_id", "glucose_diff", "time_diff", "rate_of_change"
    )


@check(
    "q4_sudden_changes",
    T_FLAG
    + 'SELECT id, patient_id, "timestamp", value, rate_of_change FROM flagged WHERE sudden_change',
    "value rate_of_change",
)
def _(spark, d):
    return anomalies.anomaly_subset(flagged(spark, d), "sudden_changes").select(
        "id", "patient_id", "timestamp", "value", "rate_of_change"
    )


@check(
    "q5_data_gaps",
    T_FLAG
    + """SELECT id, patient_id, "timestamp", value, time_diff AS gap_duration
         FROM flagged WHERE data_gap""",
    "value gap_duration",
)
def _(spark, d):
    return anomalies.anomaly_subset(flagged(spark, d), "data_gaps").select(
        "id", "patient_id", "timestamp", "value", "gap_duration"
    )


@check(
    "q6_anomaly_labels",
    T_FLAG + 'SELECT id, patient_id, "timestamp", value, anomaly_type FROM flagged WHERE anomaly',
    "value",
)
def _(spark, d):
    return anomalies.anomaly_subset(flagged(spark, d)).select(
        "id", "patient_id", "timestamp", "value", "anomaly_type"
    )


@check(
    "q6_anomaly_labels_crowded_days",
    T_FLAG + 'SELECT id, patient_id, "timestamp", value, anomaly_type FROM flagged WHERE anomaly',
    "value",
)
def _(spark, d):
    """The same rows when most days hold more readings than one task may."""
    table = anomalies.flag_anomalies(readings(spark, d), Settings(max_slice_rows=150))
    return anomalies.anomaly_subset(table).select(
        "id", "patient_id", "timestamp", "value", "anomaly_type"
    )


@check(
    "q6_label_array",
    T_FLAG
    + """SELECT id, replace(rtrim(anomaly_type, ','), ',', ' & ') AS labels FROM flagged WHERE anomaly""",
)
def _(spark, d):
    rows = anomalies.label_array(flagged(spark, d)).where("anomaly")
    return rows.select("id", F.array_join("anomaly_types", " & ").alias("labels"))


@check(
    "q7_subsets",
    T_FLAG
    + " UNION ALL ".join(
        f"SELECT id, patient_id, '{name}' AS subset FROM flagged WHERE {flag}"
        for name, flag in S.SUBSETS.items()
    ),
)
def _(spark, d):
    return anomalies.tag_subsets(flagged(spark, d)).select("id", "patient_id", "subset")


COUNTS = """SELECT patient_id, count(*) FILTER (WHERE sensor_error) AS sensor_errors,
  count(*) FILTER (WHERE statistical_outlier) AS statistical_outliers,
  count(*) FILTER (WHERE sudden_change) AS sudden_changes,
  count(*) FILTER (WHERE data_gap) AS data_gaps,
  count(*) FILTER (WHERE anomaly) AS total_anomalies FROM flagged GROUP BY patient_id"""


@check("q8_anomaly_counts", T_FLAG + COUNTS)
def _(spark, d):
    return anomalies.anomaly_counts(flagged(spark, d))


@check("q8_anomaly_counts_per_user", S.with_tables(USERS, S.FLAGGED) + COUNTS)
def _(spark, d):
    return anomalies.anomaly_counts(anomalies.flag_anomalies(user_readings(spark, d)))


# --- cleaning --------------------------------------------------------------------


@check(
    "c1_valid_readings",
    T_READ + 'SELECT id, patient_id, "timestamp", value FROM readings WHERE value BETWEEN 40 AND 400',
    "value",
)
def _(spark, d):
    return cleaning.valid_readings(readings(spark, d)).drop("actual_time")


@check(
    "c1_removed_counts",
    T_READ
    + """SELECT patient_id, count(*) AS records, count(*) FILTER (WHERE value BETWEEN 40 AND 400) AS kept,
         count(*) - count(*) FILTER (WHERE value BETWEEN 40 AND 400) AS removed
         FROM readings GROUP BY patient_id""",
)
def _(spark, d):
    return cleaning.removed_counts(readings(spark, d))


@check("c2_winsor_bounds", T_CLIP + "SELECT patient_id, total, q01, q99 FROM bounds", "q01 q99")
def _(spark, d):
    return cleaning.winsor_bounds(cleaning.valid_readings(readings(spark, d)))[0].select(
        "patient_id", "total", "q01", "q99"
    )


@check(
    "c2_winsorized",
    T_CLIP + 'SELECT id, patient_id, "timestamp", value FROM clipped',
    "value",
)
def _(spark, d):
    return cleaning.winsorize(cleaning.valid_readings(readings(spark, d))).drop("actual_time")


@check(
    "c2_winsorized_by_shuffle",
    T_CLIP + 'SELECT id, patient_id, "timestamp", value FROM clipped',
    "value",
)
def _(spark, d):
    """The same rows when there are too many patients to broadcast, and bins are crowded."""
    valid = cleaning.valid_readings(readings(spark, d))
    crowded = Settings(broadcast_rows=1, max_slice_rows=100, quantile_bins=16)
    return cleaning.winsorize(valid, crowded).drop("actual_time")


GRID_ROWS = """SELECT patient_id, hour_ts, glucose, glucose_std, glucose_min, glucose_max, reading_count
  FROM """
GRID_DOUBLES = "glucose glucose_std glucose_min glucose_max"


def _winsorized(rows: DataFrame) -> DataFrame:
    return cleaning.winsorize(cleaning.valid_readings(rows))


@check("c3_hourly_grid", S.with_tables(READ, S.CLIPPED, S.grid()) + GRID_ROWS + "grid", GRID_DOUBLES)
def _(spark, d):
    return cleaning.resample(_winsorized(readings(spark, d)))


@check(
    "c3_daily_grid",
    S.with_tables(USERS, S.CLIPPED, S.grid("date_trunc('day', \"timestamp\")", "1 DAY"))
    + GRID_ROWS
    + "grid",
    GRID_DOUBLES,
)
def _(spark, d):
    return cleaning.resample(_winsorized(user_readings(spark, d)), "D")


@check(
    "c3_weekly_grid",
    S.with_tables(
        USERS,
        S.CLIPPED,
        S.grid("date_trunc('week', \"timestamp\") + INTERVAL 6 DAY", "7 DAY"),
    )
    + GRID_ROWS
    + "grid",
    GRID_DOUBLES,
)
def _(spark, d):
    return cleaning.resample(_winsorized(user_readings(spark, d)), "W")


@check("c4_hourly_interpolated", T_HOUR + GRID_ROWS + "hourly", GRID_DOUBLES)
def _(spark, d):
    return hourly(spark, d)


@check(
    "c4_whole_gaps_only",
    S.with_tables(
        USERS,
        S.HOURLY.replace("date_diff('hour', t0, hour_ts) <= 24", "date_diff('hour', t0, t1) - 1 <= 24"),
    )
    + GRID_ROWS
    + "hourly",
    GRID_DOUBLES,
)
def _(spark, d):
    return cleaning.clean(user_readings(spark, d), whole_gaps_only=True)


@check(
    "c4_hourly_interpolated_per_user",
    S.with_tables(USERS, S.HOURLY) + GRID_ROWS + "hourly",
    GRID_DOUBLES,
)
def _(spark, d):
    return cleaning.clean(user_readings(spark, d))


# --- features ----------------------------------------------------------------------

KEY = "SELECT patient_id, hour_ts, "
T_WIDE = T_FEAT


@check("f1_calendar", T_HOUR + KEY + S.CALENDAR + " FROM hourly")
def _(spark, d):
    return features.add_calendar(hourly(spark, d).select("patient_id", "hour_ts"))


def _selected(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("patient_id", "hour_ts", *columns)


@check("f2_lags", T_WIDE + KEY + ", ".join(S.LAG_COLUMNS) + " FROM wide", " ".join(S.LAG_COLUMNS))
def _(spark, d):
    return _selected(features.add_lags(hourly(spark, d)), S.LAG_COLUMNS)


@check(
    "f3_rolling_mean",
    T_WIDE + KEY + ", ".join(S.MEAN_COLUMNS) + " FROM wide",
    " ".join(S.MEAN_COLUMNS),
)
def _(spark, d):
    return _selected(features.add_rolling(hourly(spark, d)), S.MEAN_COLUMNS)


@check(
    "f4_rolling_std", T_WIDE + KEY + ", ".join(S.STD_COLUMNS) + " FROM wide", " ".join(S.STD_COLUMNS)
)
def _(spark, d):
    return _selected(features.add_rolling(hourly(spark, d)), S.STD_COLUMNS)


@check(
    "f5_differences",
    T_WIDE + KEY + ", ".join(S.DIFF_COLUMNS) + " FROM wide",
    " ".join(S.DIFF_COLUMNS),
)
def _(spark, d):
    return _selected(features.add_differences(hourly(spark, d)), S.DIFF_COLUMNS)


ALL_FEATURES = (
    KEY + GRID_DOUBLES.replace(" ", ", ") + ", reading_count, " + ", ".join(S.INPUTS) + " FROM features"
)
FEATURE_DOUBLES = GRID_DOUBLES + " " + " ".join(S.STATE_COLUMNS)


@check("f6_features", T_FEAT + ALL_FEATURES, FEATURE_DOUBLES)
def _(spark, d):
    return feature_table(spark, d)


@check(
    "f6_features_per_user", S.with_tables(USERS, S.features()) + ALL_FEATURES, FEATURE_DOUBLES
)
def _(spark, d):
    return features.build_features(cleaning.clean(user_readings(spark, d)))


@check(
    "f6_features_leak_free", S.with_tables(READ, S.features(True)) + ALL_FEATURES, FEATURE_DOUBLES
)
def _(spark, d):
    return feature_table(spark, d, True)


@check(
    "f7_weekend_flag",
    T_HOUR + KEY + "CAST(isodow(hour_ts) >= 6 AS INTEGER) AS is_weekend FROM hourly",
)
def _(spark, d):
    return features.add_calendar(hourly(spark, d), True).select(
        "patient_id", "hour_ts", "is_weekend"
    )


FRAME24 = "(PARTITION BY patient_id ORDER BY hour_ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@check(
    "f8_expanding_rolling",
    T_HOUR
    + f"""{KEY} avg(glucose) OVER {FRAME24} AS glucose_rolling_mean,
          stddev_samp(glucose) OVER {FRAME24} AS glucose_rolling_std FROM hourly""",
    "glucose_rolling_mean glucose_rolling_std",
)
def _(spark, d):
    return _selected(
        features.add_expanding_rolling(hourly(spark, d)),
        ["glucose_rolling_mean", "glucose_rolling_std"],
    )


SCALED = ["hour", "day_of_week", "glucose_lag_1h", "glucose_lag_24h", "glucose_rolling_mean_72h"]


@check(
    "f10_standard_scaling",
    T_FEAT
    + KEY
    + ", ".join(
        f"""({c} - avg({c}) OVER p) / coalesce(nullif(stddev_pop({c}) OVER p, 0), 1) AS {c}"""
        for c in SCALED
    )
    + " FROM features WINDOW p AS (PARTITION BY patient_id)",
    " ".join(SCALED),
)
def _(spark, d):
    return _selected(features.standard_scale(feature_table(spark, d), SCALED), SCALED)


# --- patterns ------------------------------------------------------------------------

PROFILE_DOUBLES = "mean_glucose std_glucose band_low band_high"


def _profile_sql(key: str, name: str, source: str, value: str) -> str:
    return f"""SELECT patient_id, CAST({key} AS INTEGER) AS {name}, avg({value}) AS mean_glucose,
      stddev_samp({value}) AS std_glucose, count({value}) AS hours,
      avg({value}) - stddev_samp({value}) AS band_low,
      avg({value}) + stddev_samp({value}) AS band_high FROM {source} GROUP BY 1, 2"""


HOURS_SQL = _profile_sql("hour(hour_ts)", "hour", "hourly", "glucose")
DAYS_SQL = _profile_sql("isodow(hour_ts) - 1", "day_of_week", "hourly", "glucose")


@check("p1_hour_profile", T_HOUR + HOURS_SQL, PROFILE_DOUBLES)
def _(spark, d):
    return patterns.hour_profile(hourly(spark, d))


@check("p2_weekday_profile", T_HOUR + DAYS_SQL, PROFILE_DOUBLES)
def _(spark, d):
    return patterns.weekday_profile(hourly(spark, d))


def _peak_sql(profile_sql: str, key: str) -> str:
    return f"""SELECT patient_id, max(CASE WHEN top = 1 THEN {key} END) AS peak_{key},
      max(mean_glucose) AS peak_mean, max(CASE WHEN low = 1 THEN {key} END) AS trough_{key},
      min(mean_glucose) AS trough_mean
      FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY mean_glucose DESC, {key}) AS top,
                   row_number() OVER (PARTITION BY patient_id ORDER BY mean_glucose, {key}) AS low
            FROM ({profile_sql})) GROUP BY patient_id"""


@check("p3_peak_hours", T_HOUR + _peak_sql(HOURS_SQL, "hour"), "peak_mean trough_mean")
def _(spark, d):
    return patterns.peak_and_trough(patterns.hour_profile(hourly(spark, d)), "hour")


@check("p3_peak_days", T_HOUR + _peak_sql(DAYS_SQL, "day_of_week"), "peak_mean trough_mean")
def _(spark, d):
    return patterns.peak_and_trough(patterns.weekday_profile(hourly(spark, d)), "day_of_week")


TREND = """, lined AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY hour_ts) - 1 AS x FROM hourly),
fits AS (SELECT patient_id, CASE WHEN count(glucose) = count(*) THEN regr_slope(glucose, x) END AS slope,
  CASE WHEN count(glucose) = count(*) THEN regr_intercept(glucose, x) END AS intercept,
  CASE WHEN count(glucose) = count(*) THEN regr_r2(glucose, x) END AS r2 FROM lined GROUP BY 1)
SELECT *, CASE WHEN slope > 0 THEN 'increasing' WHEN slope IS NOT NULL THEN 'decreasing' END AS direction
FROM fits"""


@check("p4_linear_trend", T_HOUR.rstrip() + TREND, "slope intercept r2")
def _(spark, d):
    return patterns.linear_trend(hourly(spark, d))


@check(
    "p5_variability",
    T_HOUR
    + """SELECT patient_id, stddev_samp(glucose) AS std_glucose, avg(glucose) AS mean_glucose,
         stddev_samp(glucose) * 100 / avg(glucose) AS cv_percent FROM hourly GROUP BY 1""",
    "std_glucose mean_glucose cv_percent",
)
def _(spark, d):
    return patterns.variability(hourly(spark, d))


DIST_DOUBLES = "mean_glucose median_glucose std_glucose min_glucose max_glucose"
DIST = """SELECT patient_id, avg(glucose) AS mean_glucose, median(glucose) AS median_glucose,
  stddev_samp(glucose) AS std_glucose, min(glucose) AS min_glucose, max(glucose) AS max_glucose
  FROM hourly GROUP BY 1"""


@check("p6_distribution", T_HOUR + DIST, DIST_DOUBLES)
def _(spark, d):
    return patterns.distribution_summary(hourly(spark, d))


@check("p6_distribution_per_user", S.with_tables(USERS, S.HOURLY) + DIST, DIST_DOUBLES)
def _(spark, d):
    return patterns.distribution_summary(cleaning.clean(user_readings(spark, d)))


SHARE_COLUMNS = "below_percent in_range_percent above_percent"


def _range_sql(v: str, source: str) -> str:
    return f"""SELECT patient_id, count(*) AS total_hours, count(*) FILTER (WHERE {v} < 70) AS below_hours,
      count(*) FILTER (WHERE {v} BETWEEN 70 AND 180) AS in_range_hours,
      count(*) FILTER (WHERE {v} > 180) AS above_hours,
      count(*) FILTER (WHERE {v} < 70) * 100.0 / count(*) AS below_percent,
      count(*) FILTER (WHERE {v} BETWEEN 70 AND 180) * 100.0 / count(*) AS in_range_percent,
      count(*) FILTER (WHERE {v} > 180) * 100.0 / count(*) AS above_percent
      FROM {source} GROUP BY patient_id"""


@check("p7_time_in_range", T_HOUR + _range_sql("glucose", "hourly"), SHARE_COLUMNS)
def _(spark, d):
    return patterns.time_in_range(hourly(spark, d))


@check(
    "p7_time_in_range_per_user",
    S.with_tables(USERS, S.HOURLY) + _range_sql("glucose", "hourly"),
    SHARE_COLUMNS,
)
def _(spark, d):
    return patterns.time_in_range(cleaning.clean(user_readings(spark, d)))


HISTOGRAM = """, edges AS (
  SELECT patient_id, min(glucose) AS lo, (max(glucose) - min(glucose)) / 50e0 AS width
  FROM hourly GROUP BY 1),
slots50 AS (SELECT *, unnest(generate_series(0, 49)) AS bin FROM edges),
hits AS (SELECT patient_id, least(floor((glucose - lo) / width), 49) AS bin, count(*) AS n
         FROM hourly JOIN edges USING (patient_id) WHERE glucose IS NOT NULL GROUP BY 1, 2)
SELECT s.patient_id, CAST(s.bin AS INTEGER) AS bin, lo + width * s.bin AS bin_low,
       lo + width * (s.bin + 1) AS bin_high, coalesce(n, 0) AS n
FROM slots50 s LEFT JOIN hits h ON h.patient_id = s.patient_id AND h.bin = s.bin"""


@check("p8_histogram", T_HOUR.rstrip() + HISTOGRAM, "bin_low bin_high")
def _(spark, d):
    return patterns.histogram(kept_hourly(spark, d))


BOX = """, quarts AS (
  SELECT patient_id, quantile_cont(glucose, CAST(0.25 AS DOUBLE)) AS q1,
         quantile_cont(glucose, CAST(0.5 AS DOUBLE)) AS median_glucose,
         quantile_cont(glucose, CAST(0.75 AS DOUBLE)) AS q3 FROM hourly GROUP BY 1)
SELECT patient_id, q1, median_glucose, q3,
  min(glucose) FILTER (WHERE glucose BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(glucose) FILTER (WHERE glucose BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE glucose NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM hourly JOIN quarts USING (patient_id) GROUP BY 1, 2, 3, 4"""


@check("p9_box_plot", T_HOUR.rstrip() + BOX, "q1 median_glucose q3 whisker_low whisker_high")
def _(spark, d):
    return patterns.box_plot(kept_hourly(spark, d))


@check(
    "p10_dataset_summary",
    T_HOUR
    + f"""SELECT patient_id, raw_readings, hourly_rows, from_time, to_time,
          {_days("to_time", "from_time")} AS duration_days
          FROM (SELECT patient_id, count(*) AS raw_readings FROM readings GROUP BY 1)
          LEFT JOIN (SELECT patient_id, count(*) AS hourly_rows, min(hour_ts) AS from_time,
                            max(hour_ts) AS to_time FROM hourly GROUP BY 1) USING (patient_id)""",
)
def _(spark, d):
    rows = readings(spark, d)
    return profile.dataset_summary(rows, cleaning.clean(rows))


@check(
    "p11_daily_means",
    T_CAST
    + """SELECT patient_id, CAST("timestamp" AS DATE) AS date, avg(predicted_glucose) AS mean_glucose,
         count(*) AS hours FROM ahead GROUP BY 1, 2""",
    "mean_glucose",
)
def _(spark, d):
    return patterns.daily_means(_ahead(spark, d))


MONTH = """SELECT patient_id, CAST(date_trunc('month', "timestamp") AS TIMESTAMP) AS month,
  avg(predicted_glucose) AS avg_glucose, min(predicted_glucose) AS min_glucose,
  max(predicted_glucose) AS max_glucose, stddev_samp(predicted_glucose) AS std_glucose
  FROM ahead GROUP BY 1, 2"""


@check(
    "p12_monthly_stats",
    S.with_tables(READ, S.forecast(8760)) + MONTH,
    "avg_glucose min_glucose max_glucose std_glucose",
)
def _(spark, d):
    return patterns.monthly_stats(_ahead(spark, d, 8760))


@check(
    "p13_compare_horizons",
    S.with_tables(READ, S.forecast(8760))
    + " UNION ALL ".join(
        f"""SELECT patient_id, '{name}' AS period, CAST({hours} AS INTEGER) AS period_hours,
            count(predicted_glucose) AS hours, avg(predicted_glucose) AS avg_glucose,
            min(predicted_glucose) AS min_glucose, max(predicted_glucose) AS max_glucose,
            stddev_samp(predicted_glucose) AS std_glucose FROM ahead WHERE step <= {hours} GROUP BY 1"""
        for name, hours in (
            ("1 Week", 168), ("1 Month", 720), ("3 Months", 2160), ("6 Months", 4320), ("1 Year", 8760),
        )
    ),
    "avg_glucose min_glucose max_glucose std_glucose",
)
def _(spark, d):
    history = kept_hourly(spark, d)
    grid = forecasting.future_grid(history, 8760)
    ahead = seasonal.fit_seasonal_trend(history).predict(grid).transform(forecasting.clip_forecast)
    return patterns.compare_horizons(ahead)


@check(
    "p14_slot_diversity",
    T_HOUR
    + """SELECT patient_id, CAST(isodow(hour_ts) - 1 AS INTEGER) AS day_of_week,
         CAST(hour(hour_ts) AS INTEGER) AS hour, count(glucose) AS weeks,
         stddev_pop(glucose) AS std_glucose FROM hourly GROUP BY 1, 2, 3""",
    "std_glucose",
)
def _(spark, d):
    return patterns.slot_diversity(hourly(spark, d), "glucose", "hour_ts")


@check(
    "p14_hourly_diversity",
    T_CAST
    + """SELECT patient_id, sum(k) / 24e0 AS mean_distinct_values FROM (
         SELECT patient_id, hour("timestamp"), count(DISTINCT round_even(predicted_glucose, 1)) AS k
         FROM ahead GROUP BY 1, 2) GROUP BY 1""",
    "mean_distinct_values",
)
def _(spark, d):
    return patterns.hourly_diversity(_ahead(spark, d))


@check(
    "p15_forecast_hour_profile",
    T_CAST + _profile_sql('hour("timestamp")', "hour", "ahead", "predicted_glucose"),
    PROFILE_DOUBLES,
)
def _(spark, d):
    return patterns.hour_profile(_ahead(spark, d), "predicted_glucose", "timestamp")


@check(
    "p15_forecast_weekday_profile",
    T_CAST + _profile_sql('isodow("timestamp") - 1', "day_of_week", "ahead", "predicted_glucose"),
    PROFILE_DOUBLES,
)
def _(spark, d):
    return patterns.weekday_profile(_ahead(spark, d), "predicted_glucose", "timestamp")


@check(
    "p7_forecast_time_in_range", T_CAST + _range_sql("predicted_glucose", "ahead"), SHARE_COLUMNS
)
def _(spark, d):
    return patterns.time_in_range(_ahead(spark, d), "predicted_glucose")


@check(
    "p15_forecast_peak_days",
    T_CAST
    + _peak_sql(
        _profile_sql('isodow("timestamp") - 1', "day_of_week", "ahead", "predicted_glucose"),
        "day_of_week",
    ),
    "peak_mean trough_mean",
)
def _(spark, d):
    days = patterns.weekday_profile(_ahead(spark, d), "predicted_glucose", "timestamp")
    return patterns.peak_and_trough(days, "day_of_week")


@check(
    "p16_kpi_row",
    S.with_tables(READ, S.FLAGGED, S.HOURLY)
    + f"""SELECT patient_id, total_readings, avg_glucose, time_in_range_percent, total_anomalies
          FROM (SELECT patient_id, count(*) AS total_readings FROM readings GROUP BY 1)
          LEFT JOIN (SELECT patient_id, avg(glucose) AS avg_glucose,
             count(*) FILTER (WHERE glucose BETWEEN 70 AND 180) * 100.0 / count(*) AS time_in_range_percent
             FROM hourly GROUP BY 1) USING (patient_id)
          LEFT JOIN ({COUNTS}) USING (patient_id)""",
    "avg_glucose time_in_range_percent",
)
def _(spark, d):
    rows = readings(spark, d)
    counts = anomalies.anomaly_counts(anomalies.flag_anomalies(rows), with_total=True)
    return patterns.kpi_row(rows, cleaning.clean(rows), counts)


@check(
    "p16_dashboard",
    S.with_tables(READ, S.FLAGGED, S.HOURLY)
    + f"""SELECT h.*, {_days("to_time", "from_time")} AS duration_days, total_anomalies
          FROM (SELECT patient_id, count(*) AS total_readings, min(hour_ts) AS from_time,
                  max(hour_ts) AS to_time, avg(glucose) AS mean_glucose, median(glucose) AS median_glucose,
                  stddev_samp(glucose) AS std_glucose, min(glucose) AS min_glucose,
                  max(glucose) AS max_glucose,
                  count(*) FILTER (WHERE glucose < 70) * 100.0 / count(*) AS below_percent,
                  count(*) FILTER (WHERE glucose BETWEEN 70 AND 180) * 100.0 / count(*) AS in_range_percent,
                  count(*) FILTER (WHERE glucose > 180) * 100.0 / count(*) AS above_percent
                FROM hourly GROUP BY 1) h LEFT JOIN ({COUNTS}) USING (patient_id)""",
    DIST_DOUBLES + " " + SHARE_COLUMNS,
)
def _(spark, d):
    rows = readings(spark, d)
    counts = anomalies.anomaly_counts(anomalies.flag_anomalies(rows))
    return patterns.dashboard(cleaning.clean(rows), counts)


@check(
    "p17_plot_series",
    T_CAST
    + """SELECT patient_id, hour_ts AS "timestamp", 'actual' AS series, glucose AS value,
           CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound, false AS is_future
         FROM hourly
         UNION ALL
         SELECT patient_id, "timestamp", CASE WHEN is_future THEN 'forecast' ELSE 'fitted' END,
           predicted_glucose, CASE WHEN is_future THEN lower_bound END,
           CASE WHEN is_future THEN upper_bound END, is_future FROM forecast""",
    "value lower_bound upper_bound",
)
def _(spark, d):
    history = kept_hourly(spark, d)
    grid = forecasting.future_grid(history, 168)
    table = forecasting.seasonal_forecast(seasonal.fit_seasonal_trend(history), history, grid)
    return patterns.plot_series(history, table)


# --- models --------------------------------------------------------------------------

FORECAST_DOUBLES = "predicted_glucose lower_bound upper_bound trend"
FORECAST_ROWS = """SELECT patient_id, "timestamp", predicted_glucose, lower_bound, upper_bound, trend,
  is_future FROM """


@check("m1_seasonal_trend", T_CAST + FORECAST_ROWS + "forecast", FORECAST_DOUBLES)
def _(spark, d):
    return _seasonal(spark, d)


@check("m1_fourier_trend")
def _(spark, d):
    history = kept_hourly(spark, d)
    grid = forecasting.future_grid(history, 168)
    return forecasting.seasonal_forecast(seasonal.fit_fourier_trend(history), history, grid)


@check("m1_map_trend")
def _(spark, d):
    history = kept_hourly(spark, d)
    grid = forecasting.future_grid(history, 168)
    return forecasting.seasonal_forecast(seasonal_map.fit_map_trend(history), history, grid)


def _path_uniform(stream: int, salt: int = 1, seed: int = 7) -> str:
    text = f"patient_id || '|' || epoch_us(\"timestamp\") || '|' || draw || '|{seed}|{stream}|{salt}'"
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


@check(
    "m1_drawn_bounds",
    T_CAST.rstrip()
    + f""", noise AS (SELECT patient_id, stddev_samp(glucose) AS sigma FROM hourly GROUP BY 1),
    paths AS (
      SELECT f.patient_id, "timestamp", f.step, trend, yhat / trend AS season, sigma, draw,
             CAST(f.step - 1 AS DOUBLE) AS hours_on, {_path_uniform(6)} - 0.5e0 AS side, {_path_uniform(5)} < 0.05e0 AS changes,
             sqrt(-2e0 * ln({_path_uniform(7)})) * cos(2e0 * pi() * {_path_uniform(7, 2)}) AS normal
      FROM (SELECT * FROM raw_forecast WHERE is_future AND step <= 72) f JOIN noise USING (patient_id),
           (SELECT unnest(generate_series(1, 60)) AS draw)),
    turned AS (SELECT *, CASE WHEN changes THEN -0.3e0 * sign(side) * ln(1e0 - 2e0 * abs(side)) ELSE 0e0 END AS change FROM paths),
    valued AS (
      SELECT patient_id, "timestamp", step,
             (trend + hours_on * sum(change) OVER w - sum(change * hours_on) OVER w) * season + sigma * normal AS v
      FROM turned WINDOW w AS (PARTITION BY patient_id, draw ORDER BY step))
    SELECT patient_id, "timestamp", CAST(step AS INTEGER) AS step, quantile_cont(v, 0.025e0) AS lower_bound,
      quantile_cont(v, 0.975e0) AS upper_bound FROM valued GROUP BY ALL""",
    "lower_bound upper_bound",
)
def _(spark, d):
    """Bounds of 60 drawn futures around the seasonal model, for given chance and size of changes."""
    history = kept_hourly(spark, d)
    rows = seasonal.fit_seasonal_trend(history).predict(forecasting.future_grid(history, 72))
    rows = rows.withColumn("season", F.col("predicted_glucose") / F.col("trend"))
    changes = history.groupBy("patient_id").agg(
        F.lit(0.05).alias("change_chance"), F.lit(0.3).alias("change_size"), F.stddev_samp("glucose").alias("sigma")
    )
    return seasonal_map.drawn_bounds(rows, changes, 60, 7, 0.95).select("patient_id", "timestamp", "step", "lower_bound", "upper_bound")


def _holdout(name: str, scope: str = "pooled"):
    def run(spark, d):
        table = kept_features(spark, d, True)
        return evaluation.score_holdout(name, table, scope=scope)

    return run


T_ALL = S.with_tables(READ, S.features(True), S.split("features"), S.scaled_rows()).replace("WITH", "WITH RECURSIVE", 1).rstrip()


def _all_inputs_sql(name: str, penalty: float, pooled: bool) -> str:
    """Held-out rows of a linear model on all inputs, solved by elimination."""
    return (
        T_ALL
        + ","
        + S.solved("weights", penalty, "0" if pooled else "patient_id")
        + f""" SELECT patient_id, '{name}' AS algorithm, hour_ts, glucose AS actual, level + {S.line_value()} AS predicted
        FROM scaled JOIN weights ON g = {"0" if pooled else "patient_id"} WHERE NOT is_train"""
    )


for _name, _key, _scope, _penalty in (
    ("linear_regression", "m2_linear_regression", "pooled", 0),
    ("ridge", "m3_ridge", "pooled", 1),
    ("linear_regression", "m2_linear_regression_per_patient", "patient", 0),
    ("ridge", "m3_ridge_per_patient", "patient", 1),
):
    check(_key, _all_inputs_sql(_name, _penalty, _scope == "pooled"), "actual predicted")(_holdout(_name, _scope))
for _name, _key in (
    ("lasso", "m4_lasso"),
    ("random_forest", "m5_random_forest"),
    ("gradient_boosting", "m6_gradient_boosting"),
    ("xgboost", "m7_boosted_trees_alias"),
    ("svr", "m8_kernel_regression"),
    ("decision_tree", "m10_decision_tree"),
):
    check(_key)(_holdout(_name))
for _name, _key in (
    ("lasso", "m4_lasso_per_patient"),
    ("random_forest", "m5_random_forest_per_patient"),
    ("gradient_boosting", "m6_gradient_boosting_per_patient"),
    ("xgboost", "m7_second_order_boosting_per_patient"),
    ("svr", "m8_exact_kernel_regression"),
    ("decision_tree", "m10_decision_tree_per_patient"),
):
    check(_key)(_holdout(_name, "patient"))

# Trees of two inputs, which SQL can grow by trying every split.

TWO = ["hour", "glucose_lag_1h"]
TREE_ROWS = """, tree_rows AS (
  SELECT patient_id, hour_ts, glucose, hour, glucose_lag_1h, is_train,
         avg(glucose) FILTER (WHERE is_train) OVER (PARTITION BY patient_id) AS level,
         glucose - avg(glucose) FILTER (WHERE is_train) OVER (PARTITION BY patient_id) AS t
  FROM numbered),
"""
T_TREES = S.with_tables(READ, S.features(True), S.split("features")).rstrip() + TREE_ROWS


def _two_inputs(spark, d):
    table = feature_table(spark, d, True)
    return durable(table.select("patient_id", "hour_ts", "glucose", *TWO))


def _boosted_sql(name: str, penalty: float) -> str:
    """Two rounds of depth 2 at rate 0.1."""
    return (
        T_TREES
        + S.tree_levels("one", "tree_rows", TWO, 2, "patient_id", penalty=penalty)
        + ","
        + S.leaf_values("one", 2, "patient_id", penalty)
        + ", second AS (SELECT * EXCLUDE (node, leaf, t), t - 0.1e0 * leaf AS t, level + 0.1e0 * leaf AS fitted FROM one_value),"
        + S.tree_levels("two", "second", TWO, 2, "patient_id", penalty=penalty)
        + ","
        + S.leaf_values("two", 2, "patient_id", penalty)
        + f" SELECT patient_id, '{name}' AS algorithm, hour_ts, glucose AS actual, fitted + 0.1e0 * leaf AS predicted FROM two_value WHERE NOT is_train"
    )


@check(
    "m10_tree_two_inputs_per_patient",
    T_TREES
    + S.tree_levels("grown", "tree_rows", TWO, 4, "patient_id", 5)
    + ","
    + S.leaf_values("grown", 4, "patient_id")
    + " SELECT patient_id, 'decision_tree' AS algorithm, hour_ts, glucose AS actual, level + leaf AS predicted FROM grown_value WHERE NOT is_train",
    "actual predicted",
)
def _(spark, d):
    return evaluation.score_holdout("decision_tree", _two_inputs(spark, d), scope="patient", depth=4)


@check("m6_boosting_two_rounds_per_patient", _boosted_sql("gradient_boosting", 0), "actual predicted")
def _(spark, d):
    return evaluation.score_holdout("gradient_boosting", _two_inputs(spark, d), scope="patient", iterations=2, depth=2)


@check("m7_boosting_two_rounds_per_patient", _boosted_sql("xgboost", 1), "actual predicted")
def _(spark, d):
    return evaluation.score_holdout("xgboost", _two_inputs(spark, d), scope="patient", iterations=2, depth=2)


# The pooled form: inputs scaled by patient, cut into bins by counts in 16,384 parts of their range.
T_BINS = (
    S.with_tables(READ, S.features(True), S.split("features")).rstrip()
    + """, centred AS (
  SELECT n.patient_id, hour_ts, glucose, is_train, level, round(glucose - level, 9) AS label,
         round((hour - m) / s, 9) AS v, 0 AS everyone
  FROM numbered n JOIN (
    SELECT patient_id, avg(glucose) AS level, avg(hour) AS m, coalesce(nullif(stddev_pop(hour), 0), 1) AS s
    FROM numbered WHERE is_train GROUP BY 1) USING (patient_id)),
ends AS (SELECT min(v) AS low, max(v) AS high, count(*) AS total, avg(label) AS base FROM centred WHERE is_train),
parts AS (
  SELECT centred.*, total, round(base, 9) AS base,
         least(CAST(floor((v - low) / (high - low) * 16384) AS BIGINT), 16383) AS fine FROM centred, ends),
cut AS (
  SELECT fine, (sum(c) OVER (ORDER BY fine) - c) * 256 // total AS bin
  FROM (SELECT fine, count(*) AS c, any_value(total) AS total FROM parts WHERE is_train GROUP BY fine)),
binned AS (SELECT parts.*, bin, label - base AS t FROM parts JOIN cut USING (fine)),
"""
)


@check(
    "m7_boosting_two_rounds_pooled",
    T_BINS
    + S.tree_levels("one", "binned", ["bin"], 2, "everyone", penalty=1)
    + ","
    + S.leaf_values("one", 2, "everyone", 1)
    + ", second AS (SELECT * EXCLUDE (node, leaf, t), t - 0.1e0 * leaf AS t, level + base + 0.1e0 * leaf AS fitted FROM one_value),"
    + S.tree_levels("two", "second", ["bin"], 2, "everyone", penalty=1)
    + ","
    + S.leaf_values("two", 2, "everyone", 1)
    + " SELECT patient_id, 'xgboost' AS algorithm, hour_ts, glucose AS actual, fitted + 0.1e0 * leaf AS predicted FROM two_value WHERE NOT is_train",
    "actual predicted",
)
def _(spark, d):
    table = _two_inputs(spark, d).drop("glucose_lag_1h")
    return evaluation.score_holdout("xgboost", table, iterations=2, depth=2)


EVERY_ROW = ", numbered AS (SELECT *, true AS is_train FROM features)"


@check(
    "m13_tree_importance_per_patient",
    S.with_tables(READ, S.features(True)).rstrip()
    + EVERY_ROW
    + TREE_ROWS
    + S.tree_levels("grown", "tree_rows", TWO, 4, "patient_id", 5)
    + ", gains AS ("
    + " UNION ALL ".join(f"SELECT * FROM grown_best_{i}" for i in range(4))
    + """)
    SELECT patient_id, CASE f WHEN 0 THEN 'hour' ELSE 'glucose_lag_1h' END AS feature,
      sum(gain) / sum(sum(gain)) OVER (PARTITION BY patient_id) AS importance,
      CAST(row_number() OVER (PARTITION BY patient_id ORDER BY sum(gain) DESC) AS INTEGER) AS place
    FROM gains GROUP BY patient_id, f""",
    "importance",
)
def _(spark, d):
    return models.fit_model("decision_tree", _two_inputs(spark, d), "patient", depth=4).importances(5)


T_KNN = S.with_tables(READ, S.features(True), S.split("features"), S.neighbours())


@check(
    "m9_nearest_neighbours",
    T_KNN + "SELECT patient_id, 'knn' AS algorithm, hour_ts, actual, predicted FROM knn",
    "actual predicted",
)
def _(spark, d):
    return _holdout("knn")(spark, d)


T_FITTED = S.with_tables(READ, S.features(True)).replace("WITH", "WITH RECURSIVE", 1).rstrip() + EVERY_ROW + "," + S.scaled_rows() + "," + S.solved("weights", 1)


@check(
    "m12_training_r2",
    T_FITTED
    + f""" SELECT patient_id, count(*) AS n, 1 - sum((t - y) * (t - y)) / nullif(var_pop(t) * count(*), 0) AS r2, 'ridge' AS algorithm
    FROM (SELECT patient_id, t, {S.line_value()} AS y FROM scaled JOIN weights ON g = patient_id) GROUP BY 1""",
    "r2",
)
def _(spark, d):
    table = kept_features(spark, d, True)
    return models.training_r2(models.fit_model("ridge", table, "patient"), table)


@check("m13_feature_importance")
def _(spark, d):
    table = kept_features(spark, d, True)
    return models.fit_model("decision_tree", table).importances(5)


# --- forecasts -------------------------------------------------------------------------


def _grid_sql(first: str, step: str, periods: int) -> str:
    return f"""SELECT patient_id, last_ts, CAST(step AS INTEGER) AS step,
      {first} + (step - 1) * INTERVAL {step} AS "timestamp"
      FROM (SELECT patient_id, max(hour_ts) AS last_ts FROM hourly GROUP BY 1),
           (SELECT unnest(generate_series(1, {periods})) AS step)"""


@check("x1_future_grid", T_HOUR + _grid_sql("last_ts + INTERVAL 1 HOUR", "1 HOUR", 168))
def _(spark, d):
    return forecasting.future_grid(hourly(spark, d), 168)


@check("x1_future_grid_daily", T_HOUR + _grid_sql("last_ts + INTERVAL 1 HOUR", "1 DAY", 30))
def _(spark, d):
    return forecasting.future_grid(hourly(spark, d), 30, "D")


SUNDAY = """(last_ts + INTERVAL 1 HOUR
  + to_days(CAST(7 - isodow(last_ts + INTERVAL 1 HOUR) AS INTEGER)))"""


@check("x1_future_grid_weekly", T_HOUR + _grid_sql(SUNDAY, "7 DAY", 8))
def _(spark, d):
    return forecasting.future_grid(hourly(spark, d), 8, "W")


@check("x2_recursive_forest")
def _(spark, d):
    """168 steps of a forest of each patient, the trees evaluated for a group of patients at once."""
    history = kept_hourly(spark, d)
    table = durable(features.build_features(history, True))
    model = models.fit_model("random_forest", table, "patient")
    return forecasting.regressor_forecast(
        model, table, forecasting.future_grid(history, 168), "recursive", hourly=history
    )


@check(
    "x2_recursive_tree_one_input",
    S.with_tables(READ, S.features()).replace("WITH", "WITH RECURSIVE", 1).rstrip()
    + EVERY_ROW
    + TREE_ROWS
    + S.tree_levels("grown", "tree_rows", ["glucose_lag_1h"], 3, "patient_id", 5)
    + ","
    + S.leaf_values("grown", 3, "patient_id")
    + """, leaves AS (
      SELECT patient_id, level + leaf AS value, min(glucose_lag_1h) AS low, max(glucose_lag_1h) AS high
      FROM grown_value GROUP BY patient_id, node, level, leaf),
    pieces AS (
      SELECT patient_id, value,
        coalesce((lag(high) OVER w + low) / 2, -1e300) AS above, coalesce((lead(low) OVER w + high) / 2, 1e300) AS upto
      FROM leaves WINDOW w AS (PARTITION BY patient_id ORDER BY low)),
    latest AS (SELECT patient_id, max(hour_ts) AS last_ts, arg_max(glucose, hour_ts) AS y FROM features GROUP BY 1),
    rolled AS (
      SELECT patient_id, 0 AS step, y FROM latest
      UNION ALL
      SELECT r.patient_id, step + 1, p.value FROM rolled r JOIN pieces p
        ON p.patient_id = r.patient_id AND r.y > p.above AND r.y <= p.upto WHERE step < 168)
    SELECT patient_id, CAST(step AS INTEGER) AS step, last_ts + to_hours(CAST(step AS INTEGER)) AS "timestamp", y AS predicted_glucose
    FROM rolled JOIN (SELECT patient_id, last_ts FROM latest) USING (patient_id) WHERE step > 0""",
    "predicted_glucose",
)
def _(spark, d):
    table = _one_input(spark, d)
    model = models.fit_model("decision_tree", table, "patient", depth=3)
    ahead = forecasting.forecast_recursive(model, table, forecasting.future_grid(table, 168))
    return ahead.select("patient_id", "step", "timestamp", "predicted_glucose")


@check("x2_recursive_forecast")
def _(spark, d):
    history = kept_hourly(spark, d)
    table = durable(features.build_features(history, True))
    model = models.fit_model("ridge", table, "patient")
    return forecasting.regressor_forecast(
        model, table, forecasting.future_grid(history, 168), "recursive", hourly=history
    )


def _ahead_sql(leak_free: bool, frozen: bool) -> str:
    """History and 168 future hours of the ridge model on all inputs."""
    inputs = ", ".join(
        (f"CAST(({S.CALENDAR_OF[c].format('ts')}) AS DOUBLE)" if c in S.CALENDAR_OF else f"l.{c}" if frozen else "0e0") + f" AS {c}" for c in S.INPUTS
    )
    scaled = ", ".join(f"(f.{c} - s.{c}_m) / s.{c}_s AS {c}" for c in S.INPUTS)
    tables = S.with_tables(READ, S.features(leak_free)).replace("WITH", "WITH RECURSIVE", 1).rstrip() + EVERY_ROW + "," + S.scaled_rows() + "," + S.solved("weights", 1)
    return (
        tables
        + f""", latest AS (SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY hour_ts DESC) = 1),
    spreads AS (SELECT patient_id, stddev_samp(glucose) AS hist_std FROM features GROUP BY 1),
    later AS (SELECT l.*, hour_ts + to_hours(CAST(step AS INTEGER)) AS ts FROM latest l, (SELECT unnest(generate_series(1, 168)) AS step)),
    following AS (SELECT l.patient_id, ts, {inputs} FROM later l),
    moved_on AS (SELECT f.patient_id, ts, level, {scaled} FROM following f JOIN scales s USING (patient_id)),
    valued AS (SELECT patient_id, ts, level + {S.line_value()} AS y FROM moved_on JOIN weights ON g = patient_id)
    SELECT patient_id, hour_ts AS "timestamp", least(greatest(glucose, 40), 400) AS predicted_glucose,
      least(greatest(glucose, 40), 400) AS lower_bound, least(greatest(glucose, 40), 400) AS upper_bound,
      glucose AS trend, false AS is_future FROM features
    UNION ALL SELECT patient_id, ts, least(greatest(y, 40), 400), least(greatest(y - 0.4e0 * hist_std, 40), 400),
      least(greatest(y + 0.4e0 * hist_std, 40), 400), y, true FROM valued JOIN spreads USING (patient_id)"""
    )


@check("x3_zero_fill_forecast", _ahead_sql(False, False), FORECAST_DOUBLES)
def _(spark, d):
    table = kept_features(spark, d)
    model = models.fit_model("ridge", table, "patient")
    return forecasting.regressor_forecast(
        model, table, forecasting.future_grid(table, 168), "zero_fill"
    )


@check("x3_frozen_forecast", _ahead_sql(True, True), FORECAST_DOUBLES)
def _(spark, d):
    table = kept_features(spark, d, True)
    model = models.fit_model("ridge", table, "patient")
    return forecasting.regressor_forecast(model, table, forecasting.future_grid(table, 168))


def _draw(stream: int, ts: str = '"timestamp"', seed: int = 7) -> str:
    """The standard normal draw of a patient and time."""
    def uniform(salt: int) -> str:
        text = f"patient_id || '|' || epoch_us({ts}) || '|{seed}|{stream}|{salt}'"
        return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"

    return f"(sqrt(-2e0 * ln({uniform(1)})) * cos(2e0 * pi() * {uniform(2)}))"


@check(
    "x4_noisy_forecast",
    T_CAST.rstrip()
    + f""", spreads AS (SELECT patient_id, stddev_samp(glucose) AS s FROM hourly GROUP BY 1),
    drawn AS (SELECT f.*, CASE WHEN is_future THEN {_draw(1)} * coalesce(s, 0) * 0.2e0 ELSE 0 END AS on_mean,
      CASE WHEN is_future THEN {_draw(3)} * coalesce(s, 0) * 0.1e0 ELSE 0 END AS on_bounds
      FROM forecast f JOIN spreads USING (patient_id))
    SELECT patient_id, "timestamp", least(greatest(predicted_glucose + on_mean, 40), 400) AS predicted_glucose,
      least(greatest(lower_bound + on_bounds, 40), 400) AS lower_bound,
      least(greatest(upper_bound + on_bounds, 40), 400) AS upper_bound, trend, is_future FROM drawn""",
    FORECAST_DOUBLES,
)
def _(spark, d):
    history = kept_hourly(spark, d)
    grid = forecasting.future_grid(history, 168)
    table = forecasting.seasonal_forecast(seasonal.fit_seasonal_trend(history), history, grid)
    return forecasting.clip_forecast(forecasting.add_seasonal_noise(table, history, seed=7))


SPREAD_BOUNDS = """, spreads AS (
  SELECT patient_id, stddev_samp(glucose) AS hist_std FROM hourly GROUP BY 1),
plain AS (
  SELECT patient_id, step, "timestamp", yhat AS predicted_glucose, trend,
         yhat - 0.4e0 * hist_std AS lower_bound, yhat + 0.4e0 * hist_std AS upper_bound
  FROM (SELECT * FROM raw_forecast WHERE is_future) JOIN spreads USING (patient_id))
"""
T_PLAIN = T_CAST.rstrip() + SPREAD_BOUNDS


def _spread_forecast(spark, d):
    history = kept_hourly(spark, d)
    grid = forecasting.future_grid(history, 168)
    future = (
        seasonal.fit_seasonal_trend(history)
        .predict(grid)
        .select("patient_id", "step", "timestamp", "predicted_glucose", "trend")
    )
    return history, forecasting.add_bounds(future, history)


@check(
    "x5_bounds",
    T_PLAIN
    + 'SELECT patient_id, step, "timestamp", predicted_glucose, trend, lower_bound, upper_bound FROM plain',
    FORECAST_DOUBLES,
)
def _(spark, d):
    return _spread_forecast(spark, d)[1].withColumn("step", F.col("step").cast("bigint"))


@check(
    "x4_regressor_noise_and_noisy_bounds",
    T_PLAIN.rstrip()
    + f""", hours AS (SELECT patient_id, hour(hour_ts) AS h, stddev_samp(glucose) AS hour_std FROM hourly GROUP BY 1, 2)
    SELECT patient_id, step, "timestamp", y AS predicted_glucose, y AS trend,
      y - 0.5e0 * hist_std * (1 + {_draw(4)} * 0.1e0) AS lower_bound,
      y + 0.5e0 * hist_std * (1 + {_draw(4)} * 0.1e0) AS upper_bound
    FROM (SELECT p.patient_id, step, "timestamp", hist_std, predicted_glucose
        + coalesce({_draw(1, 'p."timestamp"').replace("patient_id ||", "p.patient_id ||")} * hist_std * 0.2e0
                 + {_draw(2, 'p."timestamp"').replace("patient_id ||", "p.patient_id ||")}
                   * coalesce(hour_std, hist_std) * 0.1e0, 0) AS y
      FROM plain p JOIN spreads USING (patient_id)
      LEFT JOIN hours h ON h.patient_id = p.patient_id AND h.h = hour(p."timestamp"))""",
    FORECAST_DOUBLES,
)
def _(spark, d):
    history, future = _spread_forecast(spark, d)
    future = forecasting.add_noise(future.drop("lower_bound", "upper_bound"), history, seed=7)
    future = forecasting.add_bounds(future, history, noisy=True, seed=7)
    return future.withColumn("step", F.col("step").cast("bigint"))


UNITED = """SELECT patient_id, hour_ts AS "timestamp", glucose AS predicted_glucose,
    glucose AS lower_bound, glucose AS upper_bound, glucose AS trend, false AS is_future FROM hourly
  UNION ALL SELECT patient_id, "timestamp", predicted_glucose, lower_bound, upper_bound, trend, true
  FROM plain"""


@check("x6_history_and_forecast", T_PLAIN + UNITED, FORECAST_DOUBLES)
def _(spark, d):
    history, future = _spread_forecast(spark, d)
    return forecasting.with_history(future, history)


@check(
    "x7_clipped_forecast",
    T_PLAIN
    + f"""SELECT patient_id, "timestamp",
          CASE WHEN predicted_glucose IS NOT NULL THEN least(greatest(predicted_glucose, 40), 400) END
            AS predicted_glucose,
          CASE WHEN lower_bound IS NOT NULL THEN least(greatest(lower_bound, 40), 400) END AS lower_bound,
          CASE WHEN upper_bound IS NOT NULL THEN least(greatest(upper_bound, 40), 400) END AS upper_bound,
          trend, is_future FROM ({UNITED})""",
    FORECAST_DOUBLES,
)
def _(spark, d):
    history, future = _spread_forecast(spark, d)
    return forecasting.clip_forecast(forecasting.with_history(future, history))


RANGE = ("2024-01-25 12:00:00", "2024-02-10 00:00:00")


@check(
    "x8_date_range_forecast",
    S.with_tables(READ, S.forecast(1000))
    + FORECAST_ROWS
    + f"""forecast WHERE "timestamp" BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'""",
    FORECAST_DOUBLES,
)
def _(spark, d):
    history = kept_hourly(spark, d)
    grid = forecasting.range_grid(history, *RANGE)
    table = forecasting.seasonal_forecast(seasonal.fit_seasonal_trend(history), history, grid)
    return forecasting.within(table, *RANGE)


@check(
    "x8_date_range_parity",
    T_HOUR
    + f"""SELECT patient_id, last_ts, CAST(step AS INTEGER) AS step,
      last_ts + to_hours(CAST(step AS INTEGER)) AS "timestamp"
      FROM (SELECT patient_id, max(hour_ts) AS last_ts FROM hourly GROUP BY 1),
           (SELECT unnest(generate_series(1, date_diff('hour', TIMESTAMP '{RANGE[0]}', TIMESTAMP '{RANGE[1]}') + 1)) AS step)
      WHERE last_ts + to_hours(CAST(step AS INTEGER)) BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'""",
)
def _(spark, d):
    return forecasting.range_grid(hourly(spark, d), *RANGE, parity=True)


@check(
    "x9_named_horizon",
    S.with_tables(READ, S.forecast(336))
    + 'SELECT patient_id, count(*) AS hours, max("timestamp") AS to_time FROM ahead GROUP BY 1',
)
def _(spark, d):
    ahead = _ahead(spark, d, forecasting.horizon("Next 2 Weeks"))
    return ahead.groupBy("patient_id").agg(
        F.count("*").alias("hours"), F.max("timestamp").alias("to_time")
    )


@check("x10_future_only", T_CAST + FORECAST_ROWS + "ahead", FORECAST_DOUBLES)
def _(spark, d):
    return _ahead(spark, d)


SUMMARY = """SELECT patient_id, count(*) AS n, min("timestamp") AS from_time, max("timestamp") AS to_time,
  avg(predicted_glucose) AS mean_predicted, min(predicted_glucose) AS min_predicted,
  max(predicted_glucose) AS max_predicted, stddev_samp(predicted_glucose) AS std_predicted
  FROM ahead GROUP BY 1"""
SUMMARY_DOUBLES = "mean_predicted min_predicted max_predicted std_predicted"


@check("x11_forecast_summary", T_CAST + SUMMARY, SUMMARY_DOUBLES)
def _(spark, d):
    return forecasting.forecast_summary(_ahead(spark, d))


@check(
    "x12_forecast_status",
    T_CAST
    + f"""SELECT *, CASE WHEN mean_predicted BETWEEN 70 AND 180 THEN 'Healthy'
             WHEN mean_predicted < 70 THEN 'Low' ELSE 'High' END AS status,
          CASE WHEN min_predicted < 70 THEN 'Low Risk' ELSE 'Safe' END AS low_risk,
          CASE WHEN max_predicted > 180 THEN 'High Risk' ELSE 'Safe' END AS high_risk
          FROM ({SUMMARY})""",
    SUMMARY_DOUBLES,
)
def _(spark, d):
    return forecasting.forecast_status(forecasting.forecast_summary(_ahead(spark, d)))


# One-input linear models have closed forms that SQL can state; they go through the
# same fitting, scaling, scoring and forecasting code as the full feature table.

LINES = S.split("features") + """,
moments AS (
  SELECT patient_id, count(*) AS n, avg(glucose_lag_1h) AS mx, stddev_pop(glucose_lag_1h) AS sx,
         avg(glucose) AS my, covar_pop(glucose_lag_1h, glucose) / stddev_pop(glucose_lag_1h) AS c
  FROM numbered WHERE is_train GROUP BY 1),
whole AS (SELECT sum(n * c) AS nc, sum(n) AS n FROM moments),
weights AS (
  SELECT m.*, c AS w_ols, c * m.n / (m.n + 1.0) AS w_ridge, sign(c) * greatest(abs(c) - 1, 0) AS w_lasso,
         nc / whole.n AS w_pooled, nc / (whole.n + 1.0) AS w_pooled_ridge FROM moments m, whole),
held AS (SELECT * FROM numbered WHERE NOT is_train)"""
T_LINES = S.with_tables(READ, S.features(), LINES)


def _line_sql(name: str, weight: str) -> str:
    return f"""SELECT patient_id, '{name}' AS algorithm, hour_ts, glucose AS actual,
      my + {weight} * (glucose_lag_1h - mx) / sx AS predicted FROM held JOIN weights USING (patient_id)"""


def _one_input(spark, d):
    table = feature_table(spark, d).select("patient_id", "hour_ts", "glucose", "glucose_lag_1h")
    return durable(table)


@check(
    "m2_m3_m4_one_input_per_patient",
    T_LINES
    + " UNION ALL ".join(
        _line_sql(n, w)
        for n, w in (("linear_regression", "w_ols"), ("ridge", "w_ridge"), ("lasso", "w_lasso"))
    ),
    "actual predicted",
)
def _(spark, d):
    table = _one_input(spark, d)
    scored = [evaluation.score_holdout(n, table, scope="patient") for n in models.LINEAR]
    return scored[0].unionByName(scored[1]).unionByName(scored[2])


@check(
    "m2_m3_one_input_pooled",
    T_LINES
    + " UNION ALL ".join(
        _line_sql(n, w) for n, w in (("linear_regression", "w_pooled"), ("ridge", "w_pooled_ridge"))
    ),
    "actual predicted",
)
def _(spark, d):
    table = _one_input(spark, d)
    return evaluation.score_holdout("linear_regression", table).unionByName(
        evaluation.score_holdout("ridge", table)
    )


@check(
    "m12_training_r2_one_input",
    T_FEAT
    + """SELECT patient_id, count(*) AS n, regr_r2(glucose, glucose_lag_1h) AS r2,
         'linear_regression' AS algorithm FROM features GROUP BY 1""",
    "r2",
)
def _(spark, d):
    table = _one_input(spark, d)
    return models.training_r2(models.fit_model("linear_regression", table, "patient"), table)


FITTED = """,
lines AS (
  SELECT patient_id, regr_slope(glucose, glucose_lag_1h) AS b, regr_intercept(glucose, glucose_lag_1h) AS a,
         max(hour_ts) AS last_ts, arg_max(glucose, hour_ts) AS last_glucose,
         arg_max(glucose_lag_1h, hour_ts) AS last_lag, stddev_samp(glucose) AS hist_std
  FROM features GROUP BY 1),
steps AS (
  SELECT *, last_ts + to_hours(CAST(step AS INTEGER)) AS "timestamp"
  FROM lines, (SELECT unnest(generate_series(1, 168)) AS step)),
rolled AS (
  SELECT patient_id, a, b, 1 AS step, a + b * last_glucose AS y FROM lines
  UNION ALL
  SELECT patient_id, a, b, step + 1, a + b * y FROM rolled WHERE step < 168)
"""
T_LINE_FORECAST = S.with_tables(READ, S.features()).rstrip().replace("WITH", "WITH RECURSIVE", 1) + FITTED


def _line_forecast_sql(y: str, source: str = "steps") -> str:
    return f"""SELECT patient_id, "timestamp", least(greatest(y, 40), 400) AS predicted_glucose,
      least(greatest(y - 0.4e0 * hist_std, 40), 400) AS lower_bound,
      least(greatest(y + 0.4e0 * hist_std, 40), 400) AS upper_bound, y AS trend, true AS is_future
      FROM (SELECT s.*, {y} AS y FROM {source})"""


def _line_forecast(mode: str):
    def run(spark, d):
        table = _one_input(spark, d)
        model = models.fit_model("linear_regression", table, "patient")
        grid = forecasting.future_grid(table, 168)
        return forecasting.future_only(
            forecasting.regressor_forecast(model, table, grid, mode)
        )

    return run


for _key, _mode, _y, _source in (
    ("x2_recursive_one_input", "recursive", "r.y", "steps s JOIN rolled r USING (patient_id, step)"),
    ("x3_frozen_one_input", "frozen", "s.a + s.b * s.last_lag", "steps s"),
    ("x3_zero_fill_one_input", "zero_fill", "s.a", "steps s"),
):
    check(_key, T_LINE_FORECAST + _line_forecast_sql(_y, _source), FORECAST_DOUBLES)(
        _line_forecast(_mode)
    )


# --- evaluation --------------------------------------------------------------------------


@check(
    "e1_chronological_split",
    S.with_tables(READ, S.features(), S.split("features"))
    + "SELECT patient_id, hour_ts, glucose, is_train FROM numbered",
    "glucose",
)
def _(spark, d):
    split = evaluation.chronological_split(feature_table(spark, d))
    return split.select("patient_id", "hour_ts", "glucose", "is_train")


SCORED_SEASONAL = f"""
train AS (SELECT patient_id, hour_ts, glucose FROM numbered WHERE is_train),{S.SEASONAL},
tested AS (SELECT patient_id, hour_ts, glucose FROM numbered WHERE NOT is_train),
seasonal_scored AS (
  SELECT patient_id, 'prophet' AS algorithm, glucose AS actual, yhat AS predicted
  FROM ({S.seasonal_prediction("tested", "hour_ts", "patient_id, hour_ts, glucose")}))"""


def _scored_seasonal(source: str) -> str:
    return S.split(source) + "," + SCORED_SEASONAL


T_METRICS = S.with_tables(
    READ,
    S.HOURLY,
    _scored_seasonal("hourly"),
    " scored AS (SELECT * FROM seasonal_scored)",
    S.METRICS,
)


@check("e2_error_metrics", T_METRICS + "SELECT * FROM metrics", S.METRIC_COLUMNS)
def _(spark, d):
    return evaluation.backtest("prophet", kept_hourly(spark, d))


@check(
    "e3_quality_bands",
    T_METRICS + f"SELECT *, {S.MAE_BAND} AS mae_band, {S.R2_BAND} AS r2_band FROM metrics",
    S.METRIC_COLUMNS,
)
def _(spark, d):
    return evaluation.with_bands(evaluation.backtest("prophet", kept_hourly(spark, d)))


def _two_algorithms() -> str:
    """Metrics of the seasonal model and of nearest neighbours, both on feature rows."""
    return S.with_tables(
        READ,
        S.features(True),
        _scored_seasonal("features"),
        S.neighbours(),
        """ scored AS (SELECT * FROM seasonal_scored UNION ALL
            SELECT patient_id, 'knn', actual, predicted FROM knn)""",
        S.METRICS,
    )


@check(
    "e5_in_sample",
    S.with_tables(
        READ,
        S.HOURLY,
        S.split("hourly"),
        SCORED_SEASONAL.replace("FROM numbered WHERE is_train", "FROM numbered"),
        " scored AS (SELECT * FROM seasonal_scored)",
        S.METRICS,
    )
    + "SELECT * FROM metrics",
    S.METRIC_COLUMNS,
)
def _(spark, d):
    return evaluation.backtest("prophet", kept_hourly(spark, d), in_sample=True)


@check(
    "x5_residual_bounds",
    S.with_tables(READ, S.HOURLY, _scored_seasonal("hourly"))
    + """SELECT patient_id, 1.96e0 * stddev_samp(actual - predicted) AS half FROM seasonal_scored GROUP BY 1""",
    "half",
)
def _(spark, d):
    """Half the width of the 95% bounds that errors on held-out rows give a forecast."""
    history = kept_hourly(spark, d)
    residuals = forecasting.residual_spread(evaluation.score_holdout("prophet", history))
    future = seasonal.fit_seasonal_trend(history).predict(forecasting.future_grid(history, 1))
    bounded = forecasting.add_bounds(
        future.drop("lower_bound", "upper_bound"), history, "residual", residuals=residuals
    )
    return bounded.select("patient_id", (F.col("upper_bound") - F.col("predicted_glucose")).alias("half"))


def user_features(spark, d):
    return durable(features.build_features(cleaning.clean(user_readings(spark, d)), True))


@check(
    "e5_holdout_per_user",
    S.with_tables(
        USERS,
        S.features(True),
        S.split("features"),
        S.neighbours(),
        " scored AS (SELECT patient_id, 'knn' AS algorithm, actual, predicted FROM knn)",
        S.METRICS,
    )
    + "SELECT * FROM metrics",
    S.METRIC_COLUMNS,
)
def _(spark, d):
    """Sparse patients: most have no training row, and are listed all the same."""
    return evaluation.backtest("knn", user_features(spark, d))


@check(
    "e4_leaderboard_per_user",
    S.with_tables(
        USERS,
        S.features(True),
        S.split("features"),
        S.neighbours(),
        S.split("hourly").replace("numbered AS", "numbered_hours AS"),
        SCORED_SEASONAL.replace("FROM numbered WHERE", "FROM numbered_hours WHERE"),
        """ scored AS (SELECT * FROM seasonal_scored UNION ALL
            SELECT patient_id, 'knn', actual, predicted FROM knn)""",
        S.METRICS,
    )
    + f"""SELECT patient_id, algorithm, n, skipped, mae, rmse, within_20, {S.MAE_BAND} AS mae_band,
          CASE WHEN n = 0 THEN 'no prediction: no training rows or no fit' END AS failure FROM metrics""",
    "mae rmse within_20",
)
def _(spark, d):
    history = durable(cleaning.clean(user_readings(spark, d)))
    table = durable(features.build_features(history, True))
    board = evaluation.compare_algorithms(history, table, ("prophet", "knn"))
    return board.select("patient_id", "algorithm", "n", "skipped", "mae", "rmse", "within_20", "mae_band", "failure")


def _two_backtests(spark, d):
    table = kept_features(spark, d, True)
    return evaluation.backtest("prophet", table).unionByName(evaluation.backtest("knn", table))


def _rank(order: str) -> str:
    return f"""CAST(row_number() OVER (PARTITION BY patient_id ORDER BY {order} NULLS LAST, algorithm)
               AS INTEGER)"""


@check(
    "e4_leaderboard",
    _two_algorithms()
    + f"""SELECT *, {S.MAE_BAND} AS mae_band, {S.R2_BAND} AS r2_band, {_rank("mae")} AS mae_rank,
          {_rank("r2 DESC")} AS r2_rank, {_rank("within_20 DESC")} AS within_20_rank FROM metrics""",
    S.METRIC_COLUMNS,
)
def _(spark, d):
    return evaluation.leaderboard(_two_backtests(spark, d))


@check(
    "e4_band_counts",
    _two_algorithms()
    + """SELECT patient_id, count(*) FILTER (WHERE mae < 15) AS excellent,
           count(*) FILTER (WHERE mae >= 15 AND mae < 25) AS good,
           count(*) FILTER (WHERE mae >= 25 AND mae < 35) AS acceptable,
           count(*) FILTER (WHERE mae >= 35) AS poor,
           arg_min(algorithm, mae) AS best_by_mae, min(mae) AS best_mae
         FROM metrics GROUP BY 1""",
    "best_mae",
)
def _(spark, d):
    return evaluation.band_counts(_two_backtests(spark, d))


@check("e4_leaderboard_models")
def _(spark, d):
    history = kept_hourly(spark, d)
    table = durable(features.build_features(history, True))
    return evaluation.compare_algorithms(history, table, models.ALGORITHMS)


@check(
    "e5_holdout_backtest",
    T_ALL
    + ","
    + S.solved("weights", 1)
    + f""", scored AS (SELECT patient_id, 'ridge' AS algorithm, glucose AS actual, level + {S.line_value()} AS predicted
      FROM scaled JOIN weights ON g = patient_id WHERE NOT is_train),{S.METRICS} SELECT * FROM metrics""",
    S.METRIC_COLUMNS,
)
def _(spark, d):
    return evaluation.backtest("ridge", kept_features(spark, d, True), scope="patient")


@check(
    "e5_holdout_one_input",
    S.with_tables(
        READ,
        S.features(),
        LINES,
        f" scored AS ({_line_sql('ridge', 'w_ridge')})",
        S.METRICS,
    )
    + "SELECT * FROM metrics",
    S.METRIC_COLUMNS,
)
def _(spark, d):
    return evaluation.backtest("ridge", _one_input(spark, d), scope="patient")


# --- report ----------------------------------------------------------------------------------

RANGE_TABLE = ["Fasting Glucose", "Post-Meal Glucose (2hr)", "Random Glucose", "Average Glucose"]


def _colour_sql(status: str) -> str:
    return f"""CASE WHEN {status} LIKE '%Normal%' OR {status} LIKE '%Excellent%' THEN 'green'
       WHEN {status} LIKE '%Good%' OR {status} LIKE '%Fair%' THEN 'orange' ELSE 'red' END"""


def _severity_sql(status: str) -> str:
    return f"""CASE WHEN {status} LIKE '%Good%' OR {status} LIKE '%Normal%' OR {status} LIKE '%Excellent%'
       THEN 'normal' WHEN {status} LIKE '%Fair%' OR {status} LIKE '%Prediabetes%' THEN 'warning'
       ELSE 'high' END"""


@check(
    "r1_range_status",
    T_READ
    + "SELECT id, patient_id, value, "
    + ", ".join(f"{S.status('value', m)} AS status_{i}" for i, m in enumerate(RANGE_TABLE))
    + ", "
    + S.status("((value + 46.7) / 28.7)", "HbA1c Equivalent")
    + " AS status_hba1c FROM readings",
    "value",
)
def _(spark, d):
    v = F.col("value")
    statuses = [ranges.range_status(v, m).alias(f"status_{i}") for i, m in enumerate(RANGE_TABLE)]
    hba1c = ranges.range_status(report.estimated_hba1c(v), "HbA1c Equivalent")
    return readings(spark, d).select(
        "id", "patient_id", "value", *statuses, hba1c.alias("status_hba1c")
    )


@check(
    "r1_continuous_ranges",
    T_READ
    + "SELECT id, value, "
    + ", ".join(f"{S.status('value', m, True)} AS status_{i}" for i, m in enumerate(RANGE_TABLE))
    + " FROM readings",
    "value",
)
def _(spark, d):
    v = F.col("value")
    statuses = [
        ranges.range_status(v, m, continuous=True).alias(f"status_{i}") for i, m in enumerate(RANGE_TABLE)
    ]
    return readings(spark, d).select("id", "value", *statuses)


@check(
    "r2_traffic_light",
    T_READ
    + f"""SELECT id, value, status, {_colour_sql("status")} AS colour FROM (
          SELECT id, value, {S.light("value", "Average Glucose")} AS status FROM readings)""",
    "value",
)
def _(spark, d):
    v = F.col("value")
    return readings(spark, d).select(
        "id",
        "value",
        ranges.light_status(v, "Average Glucose").alias("status"),
        ranges.light_colour(v, "Average Glucose").alias("colour"),
    )


METRIC_SQL = """, report_metrics AS (
  SELECT *, (average + 46.7) / 28.7 AS hba1c,
         CASE WHEN n < 168 THEN n || ' hours' ELSE (n // 24) || ' days' END AS period
  FROM (SELECT patient_id, count(*) AS n, avg(yhat) AS average, min(yhat) AS minimum, max(yhat) AS maximum,
          stddev_pop(yhat) AS deviation,
          count(*) FILTER (WHERE yhat BETWEEN 70 AND 180) * 100.0 / count(*) AS in_range,
          count(*) FILTER (WHERE yhat < 70) * 100.0 / count(*) AS below_range,
          count(*) FILTER (WHERE yhat > 180) * 100.0 / count(*) AS above_range,
          arg_min(yhat, ds) AS first_prediction, arg_max(yhat, ds) AS last_prediction
        FROM report_input GROUP BY 1))
"""
INPUT_SQL = """, report_input AS (
  SELECT patient_id, "timestamp" AS ds, predicted_glucose AS yhat, lower_bound AS yhat_lower,
         upper_bound AS yhat_upper FROM ahead)
"""
T_INPUT = T_CAST.rstrip() + INPUT_SQL
T_REPORT = T_INPUT.rstrip() + METRIC_SQL
REPORT_DOUBLES = (
    "average minimum maximum deviation in_range below_range above_range "
    "first_prediction last_prediction hba1c"
)


def _metrics(spark, d):
    return report.report_metrics(report.report_input(_seasonal(spark, d)))


@check("r3_report_metrics", T_REPORT + "SELECT * FROM report_metrics", REPORT_DOUBLES)
def _(spark, d):
    return _metrics(spark, d)


@check(
    "r4_estimated_hba1c", T_REPORT + "SELECT patient_id, average, hba1c FROM report_metrics", "average hba1c"
)
def _(spark, d):
    return _metrics(spark, d).select("patient_id", "average", "hba1c")


def _rows_sql() -> str:
    parts = []
    for i, (name, column, unit, table, text) in enumerate(S.REPORTED):
        digits = 1 if unit == "%" else 0
        parts.append(
            f"""SELECT patient_id, CAST({i} AS INTEGER) AS position, '{name}' AS parameter, {column} AS value,
                round_even({column}, {digits}) AS shown_value, '{unit}' AS unit,
                '{text}' AS reference_range,
                {S.status(column, table)} AS status FROM report_metrics WHERE {column} > 0"""
        )
    goals = (
        ("Time in Range (70-180)", "in_range", "> 70", ">70% recommended", "Needs Improvement"),
        ("Time Below Range (<70)", "below_range", "< 4", "<4% recommended", "High"),
        ("Time Above Range (>180)", "above_range", "< 25", "<25% recommended", "High"),
    )
    for i, (name, column, met, text, missed) in enumerate(goals, start=4):
        parts.append(
            f"""SELECT patient_id, CAST({i} AS INTEGER), '{name}', {column}, round_even({column}, 1), '%',
                '{text}', CASE WHEN {column} {met} THEN 'Good' ELSE '{missed}' END FROM report_metrics"""
        )
    return f"SELECT *, {_severity_sql('status')} AS severity FROM ({' UNION ALL '.join(parts)})"


@check("r5_report_rows", T_REPORT + _rows_sql(), "value shown_value")
def _(spark, d):
    return report.report_rows(_metrics(spark, d))


@check(
    "r6_range_goals",
    T_REPORT
    + """SELECT patient_id, CASE WHEN in_range > 70 THEN 'Good' ELSE 'Needs Improvement' END AS in_range_goal,
         CASE WHEN below_range < 4 THEN 'Good' ELSE 'High' END AS below_range_goal,
         CASE WHEN above_range < 25 THEN 'Good' ELSE 'High' END AS above_range_goal FROM report_metrics""",
)
def _(spark, d):
    goals = [
        report.goal_status(F.col(c), sign, limit, missed).alias(f"{c}_goal")
        for _, c, sign, limit, missed in report.GOALS
    ]
    return _metrics(spark, d).select("patient_id", *goals)


@check(
    "r7_severity",
    T_READ
    + f"""SELECT id, status, {_severity_sql("status")} AS severity FROM (
          SELECT id, {S.status("value", "Average Glucose")} AS status FROM readings)""",
)
def _(spark, d):
    status = ranges.range_status(F.col("value"), "Average Glucose")
    return readings(spark, d).select(
        "id", status.alias("status"), ranges.severity(status).alias("severity")
    )


@check(
    "r8_period_label",
    S.with_tables(USERS)
    + """SELECT patient_id, count(*) AS n,
         CASE WHEN count(*) < 168 THEN count(*) || ' hours' ELSE (count(*) // 24) || ' days' END AS period
         FROM readings GROUP BY 1""",
)
def _(spark, d):
    counts = user_readings(spark, d).groupBy("patient_id").agg(F.count("*").alias("n"))
    return counts.withColumn("period", ranges.period_label(F.col("n")))


@check("r9_report_input", T_INPUT + "SELECT * FROM report_input", "yhat yhat_lower yhat_upper")
def _(spark, d):
    return report.report_input(_seasonal(spark, d))


# --- flagship ----------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly time in range of every patient."""
    use_utc(spark)
    return settle(patterns.time_in_range(hourly(spark, sf_dir)))
