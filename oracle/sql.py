"""The same results as the Spark queries, as SQL over the given tables.

Written from the definitions of the operators, not from their Spark plans: plain
windows over a patient, a generated grid, and row-level joins.
"""

from __future__ import annotations

READINGS = """
readings AS (
  SELECT event_id AS id,
         user_id // 75 AS patient_id,
         ts AS "timestamp", 38 + 1.2 * value AS value, CAST(NULL AS TIMESTAMP) AS actual_time
  FROM events)"""

USER_READINGS = """
readings AS (
  SELECT event_id AS id, user_id AS patient_id, ts AS "timestamp",
         38 + 1.2 * value AS value, CAST(NULL AS TIMESTAMP) AS actual_time
  FROM events)"""

FLAGGED = """
stats AS (
  SELECT patient_id, avg(value) AS m, stddev_pop(value) AS s, max(value) > min(value) AS varies
  FROM readings GROUP BY patient_id),
deltas AS (
  SELECT *, value - lag(value) OVER w AS glucose_diff,
         (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER w) / 6e7 AS time_diff
  FROM readings WINDOW w AS (PARTITION BY patient_id ORDER BY "timestamp", id)),
flags AS (
  SELECT d.*,
         CASE WHEN time_diff <> 0 THEN glucose_diff / time_diff END AS rate_of_change,
         coalesce(value < 40 OR value > 400, false) AS sensor_error,
         coalesce(s.varies AND abs(value - s.m) > 3 * s.s, false) AS statistical_outlier,
         coalesce(CASE WHEN time_diff = 0 THEN glucose_diff <> 0
                       ELSE abs(glucose_diff / time_diff) > 5 END, false) AS sudden_change,
         coalesce(time_diff > 15, false) AS data_gap
  FROM deltas d JOIN stats s USING (patient_id)),
flagged AS (
  SELECT *, sensor_error OR statistical_outlier OR sudden_change AS anomaly,
         CASE WHEN sensor_error THEN 'sensor_error,' ELSE '' END
         || CASE WHEN statistical_outlier THEN 'statistical_outlier,' ELSE '' END
         || CASE WHEN sudden_change THEN 'sudden_change,' ELSE '' END AS anomaly_type
  FROM flags)"""

CLIPPED = """
valid AS (SELECT * FROM readings WHERE value BETWEEN 40 AND 400),
bounds AS (
  SELECT patient_id, count(*) AS total, quantile_cont(value, CAST(0.01 AS DOUBLE)) AS q01,
         quantile_cont(value, CAST(0.99 AS DOUBLE)) AS q99
  FROM valid GROUP BY patient_id),
clipped AS (
  SELECT v.id, v.patient_id, v."timestamp", least(greatest(v.value, b.q01), b.q99) AS value
  FROM valid v JOIN bounds b USING (patient_id))"""


def grid(label: str = "date_trunc('hour', \"timestamp\")", step: str = "1 HOUR") -> str:
    return f"""
bins AS (
  SELECT patient_id, CAST({label} AS TIMESTAMP) AS hour_ts, avg(value) AS glucose,
         stddev_samp(value) AS glucose_std, min(value) AS glucose_min,
         max(value) AS glucose_max, count(value) AS reading_count
  FROM clipped GROUP BY 1, 2),
slots AS (
  SELECT patient_id, unnest(generate_series(min(hour_ts), max(hour_ts), INTERVAL {step})) AS hour_ts
  FROM bins GROUP BY patient_id),
grid AS (
  SELECT s.patient_id, s.hour_ts, glucose, glucose_std, glucose_min, glucose_max,
         coalesce(reading_count, 0) AS reading_count
  FROM slots s LEFT JOIN bins b USING (patient_id, hour_ts))"""


HOURLY = f"""{CLIPPED},{grid()},
around AS (
  SELECT *, last_value(glucose IGNORE NULLS) OVER past AS g0,
         last_value(CASE WHEN glucose IS NOT NULL THEN hour_ts END IGNORE NULLS) OVER past AS t0,
         first_value(glucose IGNORE NULLS) OVER ahead AS g1,
         first_value(CASE WHEN glucose IS NOT NULL THEN hour_ts END IGNORE NULLS) OVER ahead AS t1
  FROM grid
  WINDOW past AS (PARTITION BY patient_id ORDER BY hour_ts
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY patient_id ORDER BY hour_ts
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
hourly AS (
  SELECT patient_id, hour_ts,
         CASE WHEN glucose IS NOT NULL THEN glucose
              WHEN date_diff('hour', t0, hour_ts) <= 24
              THEN g0 + (g1 - g0) * date_diff('hour', t0, hour_ts) / date_diff('hour', t0, t1)
         END AS glucose,
         glucose_std, glucose_min, glucose_max, reading_count
  FROM around)"""

CALENDAR = """CAST(hour(hour_ts) AS INTEGER) AS hour,
         CAST(isodow(hour_ts) - 1 AS INTEGER) AS day_of_week,
         CAST(day(hour_ts) AS INTEGER) AS day_of_month,
         CAST(month(hour_ts) AS INTEGER) AS month"""

CALENDAR_OF = {
    "hour": "hour({})",
    "day_of_week": "isodow({}) - 1",
    "day_of_month": "day({})",
    "month": "month({})",
}
LAGS = (1, 2, 3, 6, 12, 24)
WINDOWS = (6, 12, 24, 72)


def _lag(k: int) -> str:
    return f"lag(glucose, {k}) OVER w AS glucose_lag_{k}h"


def _rolling(n: int, name: str, function: str) -> str:
    frame = (
        "(PARTITION BY patient_id ORDER BY hour_ts "
        f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )
    return (
        f"CASE WHEN count(glucose) OVER {frame} = {n} THEN {function}(glucose) OVER {frame} END "
        f"AS glucose_rolling_{name}_{n}h"
    )


def _diff(k: int) -> str:
    return f"glucose - lag(glucose, {k}) OVER w AS glucose_diff_{k}h"


LAG_SQL = ", ".join(_lag(k) for k in LAGS)
MEAN_SQL = ", ".join(_rolling(n, "mean", "avg") for n in WINDOWS)
STD_SQL = ", ".join(_rolling(n, "std", "stddev_samp") for n in WINDOWS)
DIFF_SQL = ", ".join(_diff(k) for k in (1, 3))
W = "WINDOW w AS (PARTITION BY patient_id ORDER BY hour_ts)"

LAG_COLUMNS = [f"glucose_lag_{k}h" for k in LAGS]
MEAN_COLUMNS = [f"glucose_rolling_mean_{n}h" for n in WINDOWS]
STD_COLUMNS = [f"glucose_rolling_std_{n}h" for n in WINDOWS]
DIFF_COLUMNS = ["glucose_diff_1h", "glucose_diff_3h"]
STATE_COLUMNS = LAG_COLUMNS + MEAN_COLUMNS + STD_COLUMNS + DIFF_COLUMNS
CALENDAR_COLUMNS = ["hour", "day_of_week", "day_of_month", "month"]
INPUTS = CALENDAR_COLUMNS + STATE_COLUMNS
GRID_COLUMNS = ["glucose", "glucose_std", "glucose_min", "glucose_max"]


def _shifted() -> str:
    moved = {c: f"lag({c}) OVER w AS {c}" for c in MEAN_COLUMNS + STD_COLUMNS + DIFF_COLUMNS}
    return ", ".join(moved.get(c, c) for c in INPUTS)


def features(leak_free: bool = False) -> str:
    """``hourly`` and the complete rows of the feature table."""
    wide = f"""
wide AS (SELECT *, {CALENDAR}, {LAG_SQL}, {MEAN_SQL}, {STD_SQL}, {DIFF_SQL} FROM hourly {W})"""
    if leak_free:
        wide += f""",
moved AS (SELECT patient_id, hour_ts, glucose, glucose_std, glucose_min, glucose_max,
                 reading_count, {_shifted()} FROM wide {W})"""
    source = "moved" if leak_free else "wide"
    whole = " AND ".join(f"{c} IS NOT NULL" for c in GRID_COLUMNS + STATE_COLUMNS)
    return f"""{HOURLY},{wide},
features AS (SELECT * FROM {source} WHERE {whole})"""


SEASONAL = """
origin AS (SELECT patient_id, min(hour_ts) AS first_ts FROM train GROUP BY patient_id),
known AS (
  SELECT t.patient_id, t.glucose, CAST(isodow(t.hour_ts) - 1 AS INTEGER) * 24 + hour(t.hour_ts) AS slot,
         CAST(date_diff('hour', o.first_ts, t.hour_ts) AS DOUBLE) AS x
  FROM train t JOIN origin o USING (patient_id) WHERE t.glucose IS NOT NULL),
line AS (
  SELECT patient_id, coalesce(regr_slope(glucose, x), 0) AS slope,
         avg(glucose) - coalesce(regr_slope(glucose, x), 0) * avg(x) AS intercept
  FROM known GROUP BY patient_id),
relative AS (
  SELECT k.*, intercept + slope * x AS trend, glucose / (intercept + slope * x) AS share
  FROM known k JOIN line USING (patient_id)),
slot_index AS (SELECT patient_id, slot, avg(share) AS by_slot FROM relative GROUP BY 1, 2),
hour_index AS (SELECT patient_id, slot % 24 AS h, avg(share) AS by_hour FROM relative GROUP BY 1, 2),
spread AS (
  SELECT r.patient_id, sqrt(avg((glucose - trend * by_slot) * (glucose - trend * by_slot))) AS sigma
  FROM relative r JOIN slot_index USING (patient_id, slot) GROUP BY 1)"""


def seasonal_prediction(rows: str, ts: str, keep: str) -> str:
    """Select ``keep`` plus yhat, bounds and trend for the rows of a CTE."""
    return f"""
  SELECT {keep}, trend * season AS yhat,
         trend * season - 1.959963984540054 * sigma AS yhat_lower,
         trend * season + 1.959963984540054 * sigma AS yhat_upper, trend
  FROM (
    SELECT r.*, l.intercept + l.slope * (epoch_us(r.{ts}) - epoch_us(o.first_ts)) / 3.6e9 AS trend,
           coalesce(s.by_slot, h.by_hour, 1.0) AS season, p.sigma
    FROM {rows} r
    JOIN line l USING (patient_id) JOIN origin o USING (patient_id) JOIN spread p USING (patient_id)
    LEFT JOIN slot_index s ON s.patient_id = r.patient_id
         AND s.slot = (isodow(r.{ts}) - 1) * 24 + hour(r.{ts})
    LEFT JOIN hour_index h ON h.patient_id = r.patient_id AND h.h = hour(r.{ts}))"""


def forecast(periods: int = 168) -> str:
    """``forecast``: fitted history and clipped future of the seasonal model."""
    return f"""{HOURLY},
train AS (SELECT patient_id, hour_ts, glucose FROM hourly),{SEASONAL},
last AS (SELECT patient_id, max(hour_ts) AS last_ts FROM hourly GROUP BY patient_id),
future AS (
  SELECT patient_id, last_ts + to_hours(CAST(step AS INTEGER)) AS "timestamp", true AS is_future, step
  FROM last, (SELECT unnest(generate_series(1, {periods})) AS step)),
all_rows AS (
  SELECT patient_id, hour_ts AS "timestamp", false AS is_future, 0 AS step FROM hourly
  UNION ALL SELECT patient_id, "timestamp", is_future, step FROM future),
raw_forecast AS ({seasonal_prediction("all_rows", '"timestamp"', 'patient_id, "timestamp", is_future, step')}),
forecast AS (
  SELECT patient_id, "timestamp", least(greatest(yhat, 40), 400) AS predicted_glucose,
         least(greatest(yhat_lower, 40), 400) AS lower_bound,
         least(greatest(yhat_upper, 40), 400) AS upper_bound, trend, is_future, step
  FROM raw_forecast),
ahead AS (SELECT * FROM forecast WHERE is_future)"""


def split(source: str, test_size: str = "0.2") -> str:
    return f"""
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY hour_ts)
            <= floor(count(*) OVER (PARTITION BY patient_id) * (1 - CAST({test_size} AS DOUBLE)))
         AS is_train FROM {source})"""


METRICS = """
paired AS (
  SELECT patient_id, algorithm, CASE WHEN predicted IS NOT NULL THEN actual END AS a,
         CASE WHEN actual IS NOT NULL THEN predicted END AS p FROM scored),
metrics AS (
  SELECT patient_id, algorithm, count(a) AS n, count(*) - count(a) AS skipped, avg(abs(p - a)) AS mae,
         sqrt(avg((p - a) * (p - a))) AS rmse, avg(abs((a - p) / nullif(a, 0))) * 100 AS mape,
         1 - sum((p - a) * (p - a)) / nullif(var_pop(a) * count(a), 0) AS r2, max(abs(p - a)) AS max_error,
         median(abs(p - a)) AS median_error,
         covar_pop(a, p) / nullif(stddev_pop(a) * stddev_pop(p), 0) AS correlation,
         100.0 * count(*) FILTER (WHERE abs(p - a) <= 20) / nullif(count(a), 0) AS within_20
  FROM paired GROUP BY 1, 2)"""

METRIC_COLUMNS = "mae rmse mape r2 max_error median_error correlation within_20"

MAE_BAND = """CASE WHEN mae < 15 THEN 'Excellent' WHEN mae < 25 THEN 'Good'
       WHEN mae < 35 THEN 'Acceptable' WHEN mae IS NOT NULL THEN 'Poor' END"""
R2_BAND = """CASE WHEN r2 > 0.8 THEN 'Excellent' WHEN r2 > 0.6 THEN 'Good'
       WHEN r2 > 0.4 THEN 'Moderate' WHEN r2 IS NOT NULL THEN 'Poor' END"""


def neighbours(k: int = 5) -> str:
    """``knn``: held-out rows with the mean of the k nearest training rows, null without any."""
    mean = ", ".join(f"avg({c}) AS {c}_m" for c in INPUTS)
    std = ", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1) AS {c}_s" for c in INPUTS)
    scaled = ", ".join(f"(n.{c} - z.{c}_m) / z.{c}_s AS {c}" for c in INPUTS)
    distance = " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in INPUTS)
    return f"""
scales AS (SELECT patient_id, {mean}, {std} FROM numbered WHERE is_train GROUP BY patient_id),
scaled AS (SELECT n.patient_id, n.hour_ts, n.glucose, n.is_train, {scaled}
           FROM numbered n LEFT JOIN scales z USING (patient_id)),
pairs AS (
  SELECT q.patient_id, q.hour_ts, q.glucose AS actual, t.glucose AS near,
         row_number() OVER (PARTITION BY q.patient_id, q.hour_ts ORDER BY {distance}, t.hour_ts) AS place
  FROM (SELECT * FROM scaled WHERE NOT is_train) q
  LEFT JOIN (SELECT * FROM scaled WHERE is_train) t ON t.patient_id = q.patient_id),
knn AS (
  SELECT patient_id, hour_ts, any_value(actual) AS actual, avg(near) AS predicted
  FROM pairs WHERE place <= {k} GROUP BY 1, 2)"""


def settled(sql: str, doubles: str = "") -> str:
    """Cut doubles to 1e-6.

    The cut is off-centre, so that sums which end in an exact decimal tie do not
    depend on the order in which an engine adds them.
    """
    names = doubles.split()
    if not names:
        return sql
    cuts = ", ".join(f"floor({n} * 1e6 + 0.41421356) / 1e6 AS {n}" for n in names)
    return f"SELECT * REPLACE ({cuts}) FROM ({sql})"


def with_tables(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


# What the clinical tables say, written out for the checks.
RANGES = {
    "Fasting Glucose": [("Normal", 70, 99), ("Prediabetes", 100, 125), ("Diabetes", 126, 400)],
    "Post-Meal Glucose (2hr)": [("Normal", 70, 139), ("Prediabetes", 140, 199), ("Diabetes", 200, 400)],
    "Random Glucose": [("Normal", 70, 140), ("Elevated", 141, 199), ("High", 200, 400)],
    "Average Glucose": [("Excellent", 70, 120), ("Good", 121, 154), ("Fair", 155, 180), ("Poor", 181, 400)],
    "HbA1c Equivalent": [("Normal", 0, 5.6), ("Prediabetes", 5.7, 6.4), ("Diabetes", 6.5, 15)],
}
# name, figure, unit, range table, text of its ranges
REPORTED = [
    ("Average Glucose", "average", "mg/dL", "Average Glucose", "Excellent: 70-120, Good: 121-154, Fair: 155-180, Poor: 181-400"),
    ("Estimated HbA1c", "hba1c", "%", "HbA1c Equivalent", "Normal: 0-5.6, Prediabetes: 5.7-6.4, Diabetes: 6.5-15"),
    ("Minimum Predicted", "minimum", "mg/dL", "Random Glucose", "Normal: 70-140, Elevated: 141-199, High: 200-400"),
    ("Maximum Predicted", "maximum", "mg/dL", "Random Glucose", "Normal: 70-140, Elevated: 141-199, High: 200-400"),
]
# name of a subset of readings, and its flag
SUBSETS = {
    "all": "anomaly",
    "sensor_errors": "sensor_error",
    "statistical_outliers": "statistical_outlier",
    "sudden_changes": "sudden_change",
    "data_gaps": "data_gap",
}


def status(v: str, metric: str, continuous: bool = False) -> str:
    found = RANGES[metric]
    ends = [f"< {found[i + 1][1]}" if continuous and i + 1 < len(found) else f"<= {r[2]}" for i, r in enumerate(found)]
    arms = " ".join(f"WHEN {v} >= {lo} AND {v} {end} THEN '{s}'" for (s, lo, _), end in zip(found, ends))
    return f"CASE {arms} WHEN {v} < {found[0][1]} THEN 'Low' ELSE 'Critical High' END"


def light(v: str, metric: str) -> str:
    arms = " ".join(f"WHEN {v} >= {lo} AND {v} <= {hi} THEN '{s}'" for s, lo, hi in RANGES[metric])
    return f"CASE {arms} ELSE 'Critical' END"


# --- trees by trying every split -----------------------------------------------------------


def tree_levels(name: str, rows: str, inputs: list[str], depth: int, key: str, min_split: int = 2, min_leaf: int = 1, penalty: float = 0.0) -> str:
    """CTEs up to ``{name}_{depth}``: ``rows`` with the ``node`` each reaches in the tree of its ``key``.

    ``rows`` have is_train and the target t. Nodes are numbered like a heap; the splits of
    level l, with their gain, are in ``{name}_best_{l}``.
    """
    parts = [f"{name}_0 AS (SELECT *, CAST(1 AS BIGINT) AS node FROM {rows})"]
    for level in range(depth):
        at, long = f"{name}_{level}", " UNION ALL ".join(
            f"SELECT {key}, node, {i} AS f, CAST({c} AS DOUBLE) AS v, t FROM {name}_{level} WHERE is_train" for i, c in enumerate(inputs)
        )
        choose = " ".join(f"WHEN {i} THEN r.{c}" for i, c in enumerate(inputs))
        parts.append(f"""{name}_run_{level} AS (
  SELECT *, sum(s) OVER upto AS gl, sum(c) OVER upto AS nl, sum(s) OVER whole AS g, sum(c) OVER whole AS n,
         lead(v) OVER (PARTITION BY {key}, node, f ORDER BY v) AS following
  FROM (SELECT {key}, node, f, v, sum(t) AS s, count(*) AS c FROM ({long}) GROUP BY ALL)
  WINDOW upto AS (PARTITION BY {key}, node, f ORDER BY v), whole AS (PARTITION BY {key}, node, f)),
{name}_best_{level} AS (
  SELECT {key}, node, f, (v + following) / 2 AS cut, gain FROM (
    SELECT *, gl * gl / (nl + {penalty}e0) + (g - gl) * (g - gl) / (n - nl + {penalty}e0) - g * g / (n + {penalty}e0) AS gain
    FROM {name}_run_{level}
    WHERE following IS NOT NULL AND n >= {min_split} AND nl >= {min_leaf} AND n - nl >= {min_leaf})
  WHERE gain > 1e-9
  QUALIFY row_number() OVER (PARTITION BY {key}, node ORDER BY round(gain, 6) DESC, f, v) = 1),
{name}_{level + 1} AS (
  SELECT r.* EXCLUDE (node),
         CASE WHEN b.f IS NULL THEN r.node WHEN CASE b.f {choose} END <= b.cut THEN 2 * r.node ELSE 2 * r.node + 1 END AS node
  FROM {at} r LEFT JOIN {name}_best_{level} b ON b.{key} = r.{key} AND b.node = r.node)""")
    return ",\n".join(parts)


def leaf_values(name: str, depth: int, key: str, penalty: float = 0.0) -> str:
    """CTE ``{name}_value``: the rows of the last level with the ``leaf`` value they get."""
    return f"""{name}_value AS (
  SELECT r.*, leaf FROM {name}_{depth} r JOIN (
    SELECT {key}, node, sum(t) / (count(*) + {penalty}e0) AS leaf FROM {name}_{depth} WHERE is_train GROUP BY ALL) USING ({key}, node))"""


# --- linear systems of all inputs -------------------------------------------------------------


def scaled_rows(source: str = "numbered") -> str:
    """``scaled``: rows of ``source`` with inputs scaled and target ``t`` centred by the patient's training rows."""
    mean = ", ".join(f"avg({c}) AS {c}_m" for c in INPUTS)
    std = ", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1) AS {c}_s" for c in INPUTS)
    z = ", ".join(f"(n.{c} - s.{c}_m) / s.{c}_s AS {c}" for c in INPUTS)
    return f"""
scales AS (SELECT patient_id, avg(glucose) AS level, {mean}, {std} FROM {source} WHERE is_train GROUP BY patient_id),
scaled AS (SELECT n.patient_id, n.hour_ts, n.glucose, n.is_train, level, glucose - level AS t, {z}
           FROM {source} n JOIN scales s USING (patient_id))"""


def solved(name: str, penalty: float, key: str = "patient_id") -> str:
    """``{name}``: the weights ``w`` of each ``key`` by Gauss-Jordan elimination; dependent inputs get 0."""
    k = len(INPUTS)
    items = ", ".join(f"{{'i': {i}, 'z': {c}}}" for i, c in enumerate([*INPUTS, "t"], 1))
    return f"""
{name}_long AS (
  SELECT g, patient_id, hour_ts, unnest(c.i) AS i, unnest(c.z) AS z FROM (
    SELECT {key} AS g, patient_id, hour_ts, {{'i': [x.i FOR x IN l], 'z': [x.z FOR x IN l]}} AS c
    FROM (SELECT *, [{items}] AS l FROM scaled WHERE is_train))),
{name}_rows AS (
  SELECT a.g, a.i, b.i AS j, sum(a.z * b.z) + CASE WHEN a.i = b.i THEN {penalty}e0 ELSE 0e0 END AS v
  FROM {name}_long a JOIN {name}_long b USING (g, patient_id, hour_ts) WHERE a.i <= {k} GROUP BY a.g, a.i, b.i),
{name}_steps AS (
  SELECT g, CAST(1 AS BIGINT) AS k, list(r ORDER BY i) AS m
  FROM (SELECT g, i, list(v ORDER BY j) AS r FROM {name}_rows GROUP BY g, i) GROUP BY g
  UNION ALL
  SELECT g, k + 1, CASE WHEN m[k][k] < 1e-7
    THEN list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = k OR j = k THEN 0e0 ELSE v END))
    ELSE list_transform(m, lambda r, i: list_transform(r, lambda v, j:
      CASE WHEN i = k THEN v / m[k][k] ELSE v - r[k] / m[k][k] * m[k][j] END)) END
  FROM {name}_steps WHERE k <= {k}),
{name} AS (SELECT g, list_transform(m, lambda r: r[{k + 1}]) AS w FROM {name}_steps WHERE k = {k + 1})"""


def line_value(prefix: str = "") -> str:
    """Sum of weights times scaled inputs."""
    return " + ".join(f"w[{i}] * {prefix}{c}" for i, c in enumerate(INPUTS, 1))
