"""DuckDB statements giving the expected result of every registered query that SQL can express.

Each statement is the common chain of CTEs below (DuckDB skips the ones a query does not use)
followed by its own SELECT. Rounding goes through DECIMAL so that halves round up as in Spark.
"""

from __future__ import annotations

# Nothing is imported from the implementation: lists below are written out, so that a rule or column missing there
# shows as a difference.


def rnd(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def mean(x: str) -> str:
    quotient = f"CAST(CAST(sum({x}) AS DECIMAL(38,8)) AS DOUBLE) / count({x})"
    return f"CAST(CAST({quotient} AS DECIMAL(38,10)) AS DOUBLE)"


def total(x: str, digits: int = 4) -> str:
    return f"CAST(round(CAST(sum({x}) AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def rmean(x: str, digits: int = 4) -> str:
    return rnd(mean(x), digits)


def ints(names: str) -> str:
    return ", ".join(f"CAST({n} AS INTEGER) AS {n.split('(')[0]}" for n in names.split())


E = "energy_consumption"
N = "CAST(count(*) AS BIGINT) AS reading_count"
TOT_AVG = f"{total(E)} AS total_consumption, {rmean(E)} AS avg_consumption"
MEASURES = f"{TOT_AVG}, {rnd(f'max({E})', 4)} AS max_consumption, {rnd(f'min({E})', 4)} AS min_consumption, {N}"
AVG_T = f"{rmean('temperature', 2)} AS avg_temperature"
LABELS = "CASE {0} WHEN 0 THEN '{1[0]}' WHEN 1 THEN '{1[1]}' WHEN 2 THEN '{1[2]}' ELSE '{1[3]}' END"
REGIONS = ("North", "South", "East", "West")


def hour_start(ts: str) -> str:
    return f"date_trunc('hour', make_timestamp(1672531200000000 + 12 * (epoch_us({ts}) - 1704067200000000)))"


def meter_number(n: str) -> str:
    return f"'MTR-' || CASE WHEN {n} < 1000 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


def text_ts(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


FILL = ("energy_consumption", "voltage", "current", "power_factor", "temperature", "humidity")
BOUNDS = {"energy_consumption": (0, 100), "voltage": (180, 270), "current": (0, 100), "power_factor": (0.5, 1.0)}
RAW_REST = (
    "is_peak_hour, tariff_period, hvac_kwh, lighting_kwh, appliance_kwh, injected_anomaly, "
    "injected_anomaly_type, season"
)


def outside(c: str) -> str:
    low, high = BOUNDS[c]
    return f"({c} < {low} OR {c} > {high})"


def inside(c: str) -> str:
    low, high = BOUNDS[c]
    return f"CASE WHEN {c} >= {low} AND {c} <= {high} THEN {c} END AS {c}"


IMPUTE_MEANS = ", ".join(f"{mean(c)} AS mean_{c}" for c in FILL)
IMPUTE_COLS = ", ".join(f"coalesce(b.{c}, m.mean_{c}) AS {c}" for c in FILL)
SEASON = (
    "CASE WHEN month({0}) IN (12, 1, 2) THEN 'Winter' WHEN month({0}) IN (3, 4, 5) THEN 'Spring' "
    "WHEN month({0}) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"
)
PEAK = "CASE WHEN hour({0}) IN (7, 8, 9, 10, 17, 18, 19, 20, 21) THEN 1 ELSE 0 END"
WEEKEND = "CASE WHEN dayofweek({0}) IN (0, 6) THEN 1 ELSE 0 END"
BAND = (
    "CASE WHEN temperature < 5 THEN 'Very Cold' WHEN temperature < 15 THEN 'Cold' "
    "WHEN temperature < 25 THEN 'Mild' WHEN temperature < 32 THEN 'Warm' ELSE 'Hot' END"
)
CALENDAR = f"""CAST("timestamp" AS DATE) AS date, CAST(year("timestamp") AS INTEGER) AS year,
  CAST(month("timestamp") AS INTEGER) AS month, CAST(day("timestamp") AS INTEGER) AS day,
  CAST(hour("timestamp") AS INTEGER) AS hour, CAST(minute("timestamp") AS INTEGER) AS minute,
  CAST(dayofweek("timestamp") + 1 AS INTEGER) AS day_of_week,
  {WEEKEND.format('"timestamp"')} AS weekend_flag, {PEAK.format('"timestamp"')} AS peak_hour_flag,
  {SEASON.format('"timestamp"')} AS season, {BAND} AS temperature_band,
  CASE WHEN {PEAK.format('"timestamp"')} = 1 THEN 'peak' ELSE 'off_peak' END AS tariff_period"""


def history(window: str, full: bool = False) -> str:
    parts = [f'lag({E}, {k}) OVER {window} AS lag_{k}h' for k in (1, 2, 3, 24)]
    for width in (3, 24):
        frame = f'OVER ({window[1:-1]} ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)'
        for stat, fn in (("mean", "avg"), ("std", "stddev_samp")):
            value = rnd(f"{fn}({E}) {frame}", 6)
            if full:
                value = f"CASE WHEN count({E}) {frame} = {width} THEN {value} END"
            parts.append(f"{value} AS rolling_{stat}_{width}h")
    return ", ".join(parts)


HISTORY_NAMES = [
    "lag_1h", "lag_2h", "lag_3h", "lag_24h", "rolling_mean_3h", "rolling_std_3h", "rolling_mean_24h", "rolling_std_24h",
]
BASE_NAMES = [
    "timestamp", "meter_id", "meter_type", "region", "energy_consumption", "voltage", "current", "power_factor",
    "temperature", "humidity", "weather_condition", "hour", "day", "month", "year", "day_of_week", "weekend_flag",
    "peak_hour_flag", "season", "temperature_band", "date",
]
MODEL_NUMBERS = [
    "voltage", "current", "power_factor", "temperature", "humidity", "hour", "day", "month", "day_of_week",
    "weekend_flag", "peak_hour_flag",
]
WAVES = {"hour": ("hour", 24), "month": ("month", 12), "dow": ("day_of_week", 7)}
BY_METER = '(PARTITION BY meter_id ORDER BY "timestamp")'
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in HISTORY_NAMES)
BASE = ", ".join('"timestamp"' if c == "timestamp" else c for c in BASE_NAMES)
SEVERITY = (
    "CASE WHEN anomaly_flag = 0 THEN 'none' WHEN abs(anomaly_score) >= 6 THEN 'high' "
    "WHEN abs(anomaly_score) >= 4 THEN 'medium' ELSE 'low' END"
)
PREDICTED = (
    "SELECT *, {err} AS prediction_error, "
    "coalesce({pct}, 0.0) AS abs_percentage_error FROM raw_predictions"
)
ERR = rnd("predicted_consumption - actual_consumption", 4)

CTES = f"""
readings AS (
  SELECT CASE WHEN event_id % 211 = 3 THEN 'bad-ts' ELSE {text_ts(hour_start('ts'))} END AS "timestamp",
    CASE WHEN event_id % 101 = 7 THEN 'BAD-ID' ELSE {meter_number('user_id')} END AS meter_id,
    CASE user_id % 3 WHEN 0 THEN 'residential' WHEN 1 THEN ' Commercial' ELSE 'INDUSTRIAL ' END AS meter_type,
    {LABELS.format('user_id % 4', REGIONS)} AS region,
    CASE WHEN event_id % 97 <> 5 THEN value END AS energy_consumption,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) + 178 AS voltage,
    {rnd('value / CAST(2.3 AS DOUBLE)', 3)} AS current,
    (45 + event_id % 58) / 100 AS power_factor,
    CASE WHEN event_id % 37 <> 0 THEN CAST((event_id * 7) % 45 - 5 AS DOUBLE) END AS temperature,
    CAST(15 + (event_id * 11) % 85 AS DOUBLE) AS humidity,
    CASE event_type WHEN 'click' THEN ' clear' WHEN 'view' THEN 'CLOUDY ' WHEN 'purchase' THEN 'Rain'
      WHEN 'signup' THEN 'fog' END AS weather_condition,
    CAST(NULL AS INTEGER) AS is_peak_hour, CAST(NULL AS VARCHAR) AS tariff_period,
    value * CAST(0.35 AS DOUBLE) AS hvac_kwh, value * CAST(0.12 AS DOUBLE) AS lighting_kwh,
    value * CAST(0.53 AS DOUBLE) AS appliance_kwh,
    0 AS injected_anomaly, 'none' AS injected_anomaly_type, CAST(NULL AS VARCHAR) AS season,
    ts AS arrived_at
  FROM events),
meters AS (
  SELECT {meter_number('c_custkey')} AS meter_id,
    CASE c_custkey % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' ELSE 'industrial' END AS meter_type,
    {LABELS.format('c_custkey % 4', REGIONS)} AS region,
    strftime(DATE '2018-01-01' + CAST(c_custkey * 37 % 1500 AS INTEGER), '%Y-%m-%d') AS installation_date,
    CAST(230.0 AS DOUBLE) AS rated_voltage,
    1 + (c_custkey % 7) * CAST(0.85 AS DOUBLE) AS base_load_kwh
  FROM customer),
hours AS (SELECT DISTINCT {hour_start('ts')} AS moment FROM events),
weather AS (
  SELECT moment AS "timestamp",
    CAST((dayofyear(moment) * 7 + hour(moment)) % 45 - 5 AS DOUBLE) AS temperature,
    CAST(15 + (dayofyear(moment) + hour(moment)) % 85 AS DOUBLE) AS humidity,
    {LABELS.format('hour(moment) % 4', ('Clear', 'Cloudy', 'Rain', 'Fog'))} AS weather_condition
  FROM hours),
bronze AS (
  SELECT r.* EXCLUDE ("timestamp", arrived_at),
    try_strptime(r."timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", arrived_at AS ingestion_ts,
    'smart_meter_csv' AS source_system,
    CAST(try_strptime(r."timestamp", '%Y-%m-%d %H:%M:%S') AS DATE) AS event_date
  FROM readings r),
deduped AS (
  SELECT * FROM bronze
  QUALIFY row_number() OVER (PARTITION BY meter_id, "timestamp" ORDER BY ingestion_ts DESC) = 1),
valid AS (
  SELECT * FROM deduped WHERE "timestamp" IS NOT NULL AND regexp_matches(meter_id, '^MTR-[0-9]{{3}}$')),
bounded AS (
  SELECT * EXCLUDE (energy_consumption, voltage, current, power_factor),
    {', '.join(inside(c) for c in BOUNDS)} FROM valid),
meter_means AS (SELECT meter_id, {IMPUTE_MEANS} FROM bounded GROUP BY meter_id),
filled AS (
  SELECT b.* EXCLUDE ({', '.join(FILL)}), {IMPUTE_COLS}
  FROM bounded b JOIN meter_means m ON b.meter_id = m.meter_id),
labelled AS (
  SELECT * EXCLUDE (weather_condition, meter_type),
    upper(left(trim(coalesce(weather_condition, 'unknown')), 1))
      || lower(substr(trim(coalesce(weather_condition, 'unknown')), 2)) AS weather_condition,
    lower(trim(meter_type)) AS meter_type
  FROM filled),
silver AS (
  SELECT * EXCLUDE (season, tariff_period), {CALENDAR}
  FROM labelled WHERE energy_consumption IS NOT NULL),
hourly_consumption AS (
  SELECT date, hour, meter_id, {MEASURES}, {AVG_T}, max(peak_hour_flag) AS peak_hour_flag
  FROM silver GROUP BY date, hour, meter_id),
daily_consumption AS (
  SELECT date, meter_id, {MEASURES}, {AVG_T}, max(weekend_flag) AS weekend_flag, max(season) AS season
  FROM silver GROUP BY date, meter_id),
weekly_consumption AS (
  SELECT year, CAST(weekofyear("timestamp") AS INTEGER) AS week_of_year, meter_id, {TOT_AVG}, {N}
  FROM silver GROUP BY ALL),
monthly_consumption AS (SELECT year, month, meter_id, {MEASURES} FROM silver GROUP BY year, month, meter_id),
meter_totals AS (
  SELECT meter_id, meter_type, region, {MEASURES}, {rnd(f'stddev_samp({E})', 4)} AS stddev_consumption
  FROM silver GROUP BY meter_id, meter_type, region),
meter_consumption AS (
  SELECT *, CAST(row_number() OVER (ORDER BY total_consumption DESC, meter_id) AS INTEGER) AS consumption_rank
  FROM meter_totals),
peak_offpeak_consumption AS (SELECT date, tariff_period, {TOT_AVG}, {N} FROM silver GROUP BY date, tariff_period),
weather_energy AS (
  SELECT date, weather_condition, temperature_band, {AVG_T}, {rmean('humidity', 2)} AS avg_humidity, {TOT_AVG}, {N}
  FROM silver GROUP BY date, weather_condition, temperature_band),
energy_summary AS (
  SELECT {total(E, 3)} AS total_consumption, {rmean(E)} AS avg_consumption,
    {rnd(f'max({E})', 4)} AS peak_consumption, {rnd(f'min({E})', 4)} AS min_consumption,
    count(DISTINCT meter_id) AS meter_count, {N}, min("timestamp") AS period_start, max("timestamp") AS period_end
  FROM silver),
dim_date AS (
  SELECT DISTINCT date, year, month, day, day_of_week, weekend_flag, season,
    strftime(date, '%B') AS month_name, strftime(date, '%A') AS day_name, CAST(quarter(date) AS INTEGER) AS quarter
  FROM silver),
dim_meter AS (
  SELECT m.*, s.avg_consumption, s.total_consumption FROM meters m
  LEFT JOIN (SELECT meter_id, {TOT_AVG} FROM silver GROUP BY meter_id) s ON m.meter_id = s.meter_id),
ml_features AS (SELECT {BASE}, {history(BY_METER)} FROM silver),
complete AS (SELECT * FROM ml_features WHERE {COMPLETE}),
placed AS (
  SELECT *, row_number() OVER (ORDER BY "timestamp", meter_id) AS place, count(*) OVER () AS n FROM complete),
holdout AS (SELECT * FROM placed WHERE place > floor(n * CAST(0.8 AS DOUBLE))),
raw_predictions AS (
  SELECT "timestamp", meter_id, {rnd(E, 4)} AS actual_consumption, {rnd('lag_24h', 4)} AS predicted_consumption
  FROM holdout),
predictions AS (
  SELECT *, coalesce({rnd('100.0 * abs(prediction_error) / nullif(actual_consumption, 0)', 4)}, 0.0)
      AS abs_percentage_error,
    'Persistence' AS model_name, '1.0.0' AS model_version
  FROM (SELECT *, {ERR} AS prediction_error FROM raw_predictions)),
centres AS (SELECT meter_id, hour, median({E}) AS centre FROM silver GROUP BY meter_id, hour),
gaps AS (
  SELECT s."timestamp", s.meter_id, s.hour, s.{E}, s.{E} - c.centre AS gap
  FROM silver s JOIN centres c ON s.meter_id = c.meter_id AND s.hour = c.hour),
spreads AS (
  SELECT meter_id, hour, median(abs(gap)) * CAST(1.4826 AS DOUBLE) AS spread FROM gaps GROUP BY meter_id, hour),
scores AS (
  SELECT g.*, coalesce(gap / nullif(spread, 0), 0) AS score
  FROM gaps g JOIN spreads p ON g.meter_id = p.meter_id AND g.hour = p.hour),
zscore AS (
  SELECT "timestamp", meter_id, {E}, {rnd('score', 4)} AS anomaly_score,
    CASE WHEN abs(score) >= 3 THEN 1 ELSE 0 END AS anomaly_flag,
    CASE WHEN score >= 6 THEN 'sudden_spike' WHEN score >= 3 THEN 'high_consumption'
      WHEN score <= -3 THEN 'low_consumption' ELSE 'normal' END AS anomaly_type,
    'robust_zscore' AS detection_method
  FROM scores),
scored AS (SELECT *, {SEVERITY} AS anomaly_severity FROM zscore),
anomalies AS (SELECT * FROM scored WHERE anomaly_flag = 1),
wide_fact AS (
  SELECT CAST(h.date AS TIMESTAMP) AS date, h.* EXCLUDE (date),
    s.temperature, s.humidity, s.weather_condition, s.temperature_band, s.season, s.weekend_flag, s.day_of_week,
    p.predicted_consumption, p.prediction_error, p.abs_percentage_error, p.model_name,
    coalesce(a.anomaly_flag, 0) AS anomaly_flag, coalesce(a.anomaly_type, 'normal') AS anomaly_type,
    a.anomaly_score, coalesce(a.anomaly_severity, 'none') AS anomaly_severity
  FROM hourly_consumption h
  LEFT JOIN silver s ON s.date = h.date AND s.hour = h.hour AND s.meter_id = h.meter_id
  LEFT JOIN predictions p ON p.meter_id = h.meter_id AND date_trunc('hour', p."timestamp") = h.date + to_hours(h.hour)
  LEFT JOIN anomalies a ON a.meter_id = h.meter_id AND date_trunc('hour', a."timestamp") = h.date + to_hours(h.hour)),
fact_hourly_consumption AS (SELECT date AS date_key, * EXCLUDE (date) FROM hourly_consumption),
fact_daily_consumption AS (SELECT date AS date_key, * EXCLUDE (date) FROM daily_consumption),
fact_monthly_consumption AS (SELECT * FROM monthly_consumption),
fact_meter_consumption AS (SELECT * FROM meter_consumption),
fact_peak_offpeak AS (SELECT date AS date_key, * EXCLUDE (date) FROM peak_offpeak_consumption),
fact_weather_energy AS (SELECT date AS date_key, * EXCLUDE (date) FROM weather_energy),
wh_dim_date AS (
  SELECT date AS date_key, year, quarter, month, month_name, day, day_of_week, day_name, weekend_flag, season
  FROM dim_date),
fact_predictions AS (SELECT "timestamp" AS reading_ts, * EXCLUDE ("timestamp") FROM predictions),
fact_anomalies AS (
  SELECT "timestamp" AS reading_ts, meter_id, {E}, anomaly_flag, anomaly_type, anomaly_score, anomaly_severity,
    detection_method FROM anomalies)
"""

V_TOT = f"{total('total_consumption')} AS total_consumption"
V_AVG = f"{mean('avg_consumption')} AS avg_consumption"
V_EXT = "max(max_consumption) AS max_consumption, min(min_consumption) AS min_consumption"
RANKING = """SELECT meter_id, meter_type, region, total_consumption, avg_consumption, max_consumption,
  min_consumption, consumption_rank,
  CAST(rank() OVER (PARTITION BY region ORDER BY total_consumption DESC) AS INTEGER) AS region_rank
FROM fact_meter_consumption"""
SUMMARY = f"""SELECT {V_TOT}, {mean('avg_consumption')} AS average_consumption, {V_EXT},
  count(DISTINCT meter_id) AS meter_count, CAST(sum(reading_count) AS BIGINT) AS reading_count,
  min(date_key) AS period_start, max(date_key) AS period_end"""
ACCURACY = f"""SELECT model_name, model_version, count(*) AS prediction_count,
  {mean('abs(prediction_error)')} AS mae, sqrt({mean('prediction_error * prediction_error')}) AS rmse,
  {mean('abs_percentage_error')} AS mape
FROM fact_predictions WHERE actual_consumption IS NOT NULL GROUP BY model_name, model_version"""
ACTUAL_PREDICTED = """SELECT reading_ts, meter_id, actual_consumption, predicted_consumption, prediction_error,
  abs_percentage_error, model_name FROM fact_predictions"""


def pct(part: str, whole: str) -> str:
    return f"100.0 * coalesce({part} / nullif({whole}, 0), 0)"


def when_total(condition: str) -> str:
    return total(f"CASE WHEN {condition} THEN total_consumption END")


FACT_MEASURES = {
    "total_energy_consumption": total("total_consumption"),
    "average_consumption": mean("avg_consumption"),
    "peak_consumption": "max(max_consumption)",
    "minimum_consumption": "min(min_consumption)",
    "meter_count": "count(DISTINCT meter_id)",
    "total_readings": "CAST(sum(reading_count) AS BIGINT)",
    "total_anomalies": "count(*) FILTER (WHERE anomaly_flag = 1)",
    "anomaly_rate_pct": pct("CAST(count(*) FILTER (WHERE anomaly_flag = 1) AS DOUBLE)", "count(*)"),
    "high_severity_anomalies": "count(*) FILTER (WHERE anomaly_flag = 1 AND anomaly_severity = 'high')",
    "peak_consumption_share_pct": pct(when_total("peak_hour_flag = 1"), total("total_consumption")),
    "weekend_consumption": when_total("weekend_flag = 1"),
    "weekday_consumption": when_total("weekend_flag = 0"),
    "predicted_consumption": total("predicted_consumption"),
    "actual_vs_predicted_delta": rnd(
        f"{total('total_consumption')} - coalesce({total('predicted_consumption')}, 0)", 4
    ),
    "average_temperature": mean("temperature"),
    "average_humidity": mean("humidity"),
}


def measures(names: list[str] | None = None) -> str:
    return ", ".join(f"{FACT_MEASURES[n]} AS {n}" for n in names or FACT_MEASURES)


ANOMALY_LABEL = (
    "CASE anomaly_severity WHEN 'high' THEN 'High severity' WHEN 'medium' THEN 'Medium severity' "
    "WHEN 'low' THEN 'Low severity' ELSE 'Normal' END AS anomaly_label"
)
HOUR_LABEL = "lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS hour_label"
CYCLES = ", ".join(
    f"{rnd(f'{wave}(CAST(2 * pi() AS DOUBLE) * {column} / {period})', 9)} AS {prefix}_{wave}"
    for prefix, (column, period) in WAVES.items()
    for wave in ("sin", "cos")
)
LEVELS = {
    "meter_type": ("commercial", "industrial", "residential"),
    "season": ("Autumn", "Spring", "Summer", "Winter"),
    "weather_condition": ("Clear", "Cloudy", "Fog", "Rain", "Unknown"),
}
ENCODED = ", ".join(
    f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{c}_{v}\"" for c, vs in LEVELS.items() for v in vs
)
MATRIX = ", ".join(
    [f"{rnd(c, 6)} AS {c}" for c in (*MODEL_NUMBERS, *HISTORY_NAMES)] + [CYCLES, ENCODED]
)
DQ = {
    "null_timestamp": '"timestamp" IS NULL',
    "null_meter_id": "meter_id IS NULL",
    "null_energy_consumption": f"{E} IS NULL",
    "duplicate_rows": None,
    "invalid_timestamp": '"timestamp" IS NULL',
    "invalid_meter_id": "NOT regexp_matches(meter_id, '^MTR-[0-9]{3}$')",
    "invalid_energy": outside(E),
    "invalid_voltage": outside("voltage"),
    "invalid_current": outside("current"),
    "invalid_power_factor": outside("power_factor"),
}


def dq_report(layer: str) -> str:
    counts = []
    for name, test in DQ.items():
        if test is None:
            value = (
                f'(SELECT count(*) FROM (SELECT 1 FROM {layer} GROUP BY meter_id, "timestamp" HAVING count(*) > 1))'
            )
        else:
            value = f"(SELECT count(*) FROM {layer} WHERE {test})"
        counts.append(f"{value} AS {name}")
    failing = [n for n in DQ if n not in ("invalid_voltage", "invalid_current", "invalid_power_factor")]
    texts = ", ".join(f"CASE WHEN {n} > 0 THEN '{n}=' || {n} END" for n in failing)
    return f"""SELECT *, failures = '' AS passed FROM (
  SELECT *, concat_ws(',', {texts}) AS failures FROM (
    SELECT '{layer}' AS layer, (SELECT count(*) FROM {layer}) AS total_rows, {', '.join(counts)}))"""


def sql_name(table: str) -> str:
    return "wh_dim_date" if table == "dim_date" else table


# The star schema's constraints: key, NOT NULL columns, checks, references.
_SIZES = "total_consumption avg_consumption reading_count"
_FULL = "total_consumption avg_consumption max_consumption min_consumption reading_count"
CONSTRAINTS = {
    "dim_meter": ("primary_key: meter_id", "meter_id meter_type region", {"rated_voltage_positive": "rated_voltage > 0"}, ""),
    "dim_date": (
        "primary_key: date_key", "date_key year quarter month day day_of_week weekend_flag season",
        {"month_range": "month >= 1 AND month <= 12", "weekend_flag_domain": "weekend_flag = 0 OR weekend_flag = 1"}, "",
    ),
    "fact_hourly_consumption": (
        "primary_key: date_key hour meter_id", f"date_key hour meter_id {_FULL} peak_hour_flag",
        {
            "hour_range": "hour >= 0 AND hour <= 23", "total_not_negative": "total_consumption >= 0",
            "peak_hour_flag_domain": "peak_hour_flag = 0 OR peak_hour_flag = 1",
        },
        "date_key meter_id",
    ),
    "fact_daily_consumption": (
        "primary_key: date_key meter_id", f"date_key meter_id {_FULL} weekend_flag season",
        {"total_not_negative": "total_consumption >= 0"}, "date_key meter_id",
    ),
    "fact_monthly_consumption": (
        "primary_key: year month meter_id", f"year month meter_id {_FULL}", {"month_range": "month >= 1 AND month <= 12"}, "meter_id",
    ),
    "fact_peak_offpeak": (
        "primary_key: date_key tariff_period", f"date_key tariff_period {_SIZES}",
        {"tariff_period_domain": "tariff_period = 'peak' OR tariff_period = 'off_peak'"}, "date_key",
    ),
    "fact_weather_energy": (
        "primary_key: date_key weather_condition temperature_band",
        f"date_key weather_condition temperature_band {_SIZES}", {}, "date_key",
    ),
    "fact_meter_consumption": ("primary_key: meter_id", f"meter_id meter_type region {_FULL} consumption_rank", {}, "meter_id"),
    "fact_predictions": (
        "unique_reading_model: reading_ts meter_id model_name",
        "reading_ts meter_id predicted_consumption model_name model_version", {}, "meter_id",
    ),
    "fact_anomalies": (
        "unique_reading_method: reading_ts meter_id detection_method",
        "reading_ts meter_id energy_consumption anomaly_flag anomaly_type anomaly_severity detection_method",
        {"anomaly_flag_domain": "anomaly_flag = 0 OR anomaly_flag = 1"}, "meter_id",
    ),
    "energy_summary": (
        "", "total_consumption avg_consumption peak_consumption min_consumption meter_count reading_count period_start period_end",
        {}, "",
    ),
}


def constraint_rows() -> str:
    parts = []
    for table, (key, required, checks, references) in CONSTRAINTS.items():
        source = sql_name(table)

        def row(name: str, query: str) -> None:
            parts.append(f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, ({query}) AS violations")

        for c in required.split():
            row(f"not_null_{c}", f"SELECT count(*) FROM {source} WHERE {c} IS NULL")
        for name, test in checks.items():
            row(f"check_{name}", f"SELECT count(*) FROM {source} WHERE NOT ({test})")
        if key:
            name, columns = key.split(": ")
            keys = ", ".join(columns.split())
            row(name, f"SELECT count(*) FROM (SELECT {keys} FROM {source} GROUP BY {keys} HAVING count(*) > 1)")
        for c in references.split():
            target = "dim_meter" if c == "meter_id" else "dim_date"
            row(
                f"foreign_key_{c}",
                f"SELECT count(*) FROM {source} f WHERE {c} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {sql_name(target)} d WHERE d.{c} = f.{c})",
            )
    return "\nUNION ALL ".join(parts)


# The semantic model's relationships: many side, one side, cardinality.
RELATIONSHIPS = """
wide_fact.date dim_date.date many-to-one
wide_fact.meter_id dim_meter.meter_id many-to-one
daily_consumption.date dim_date.date many-to-one
daily_consumption.meter_id dim_meter.meter_id many-to-one
meter_consumption.meter_id dim_meter.meter_id one-to-one
predictions.meter_id dim_meter.meter_id many-to-one
anomalies.meter_id dim_meter.meter_id many-to-one
peak_offpeak_consumption.date dim_date.date many-to-one
weather_energy.date dim_date.date many-to-one
monthly_consumption.meter_id dim_meter.meter_id many-to-one
"""


def relationship_rows() -> str:
    parts = []
    for link in RELATIONSHIPS.strip().splitlines():
        many_side, one_side, cardinality = link.split()
        (many, column), (one, key) = many_side.split("."), one_side.split(".")
        value = f"CAST({column} AS DATE)" if key == "date" else column
        repeated_many = (
            f"(SELECT count(*) FROM (SELECT 1 FROM {many} GROUP BY {value} HAVING count(*) > 1))"
            if cardinality == "one-to-one"
            else "CAST(0 AS BIGINT)"
        )
        parts.append(
            f"SELECT '{many}.{column}' AS many_side, '{one}.{key}' AS one_side, '{cardinality}' AS cardinality, "
            f"(SELECT count(*) FROM (SELECT 1 FROM {one} GROUP BY {key} HAVING count(*) > 1)) AS repeated_one, "
            f"{repeated_many} AS repeated_many, "
            f"(SELECT count(*) FROM {many} m WHERE NOT EXISTS (SELECT 1 FROM {one} o WHERE o.{key} = {value.replace(column, 'm.' + column)})) "
            "AS unresolved"
        )
    return "\nUNION ALL ".join(parts)


# Column types as Spark names them, per profiled data set.
_CONSUMED = {"total_consumption": "double", "avg_consumption": "double"}
_SPAN = {"max_consumption": "double", "min_consumption": "double"}
_COUNT = {"reading_count": "bigint"}
_TEMP = {"avg_temperature": "double"}
PROFILES = {
    "hourly_consumption": {"date": "date", "hour": "int", "meter_id": "string", **_CONSUMED, **_SPAN, **_COUNT, **_TEMP, "peak_hour_flag": "int"},
    "daily_consumption": {"date": "date", "meter_id": "string", **_CONSUMED, **_SPAN, **_COUNT, **_TEMP, "weekend_flag": "int", "season": "string"},
    "weekly_consumption": {"year": "int", "week_of_year": "int", "meter_id": "string", **_CONSUMED, **_COUNT},
    "monthly_consumption": {"year": "int", "month": "int", "meter_id": "string", **_CONSUMED, **_SPAN, **_COUNT},
    "meter_consumption": {"meter_id": "string", "meter_type": "string", "region": "string", **_CONSUMED, **_SPAN, **_COUNT, "stddev_consumption": "double", "consumption_rank": "int"},
    "peak_offpeak_consumption": {"date": "date", "tariff_period": "string", **_CONSUMED, **_COUNT},
    "weather_energy": {"date": "date", "weather_condition": "string", "temperature_band": "string", **_TEMP, "avg_humidity": "double", **_CONSUMED, **_COUNT},
    "energy_summary": {**_CONSUMED, "peak_consumption": "double", "min_consumption": "double", "meter_count": "bigint", **_COUNT, "period_start": "timestamp", "period_end": "timestamp"},
    "dim_date": {"date": "date", "year": "int", "month": "int", "day": "int", "day_of_week": "int", "weekend_flag": "int", "season": "string", "month_name": "string", "day_name": "string", "quarter": "int"},
    "dim_meter": {"meter_id": "string", "meter_type": "string", "region": "string", "installation_date": "string", "rated_voltage": "double", "base_load_kwh": "double", **_CONSUMED},
    "predictions": {"timestamp": "timestamp", "meter_id": "string", "actual_consumption": "double", "predicted_consumption": "double", "prediction_error": "double", "abs_percentage_error": "double", "model_name": "string", "model_version": "string"},
    "anomalies": {"timestamp": "timestamp", "meter_id": "string", E: "double", "anomaly_score": "double", "anomaly_flag": "int", "anomaly_type": "string", "detection_method": "string", "anomaly_severity": "string"},
    "wide_fact": {
        "date": "timestamp", "hour": "int", "meter_id": "string", **_CONSUMED, **_SPAN, **_COUNT, **_TEMP, "peak_hour_flag": "int",
        "temperature": "double", "humidity": "double", "weather_condition": "string", "temperature_band": "string", "season": "string",
        "weekend_flag": "int", "day_of_week": "int", "predicted_consumption": "double", "prediction_error": "double",
        "abs_percentage_error": "double", "model_name": "string", "anomaly_flag": "int", "anomaly_type": "string",
        "anomaly_score": "double", "anomaly_severity": "string",
    },
}


def profile_rows(name: str) -> str:
    parts = []
    for column, kind in PROFILES[name].items():
        parts.append(
            f"SELECT '{name}' AS dataset, (SELECT count(*) FROM {name}) AS row_count, "
            f"(SELECT count(*) FROM {name}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_rows, "
            f"'{column}' AS column_name, '{kind}' AS data_type, "
            f"(SELECT count(*) FROM {name} WHERE \"{column}\" IS NULL) AS null_count"
        )
    return "\nUNION ALL ".join(parts)


WAREHOUSE = [
    "dim_meter", "dim_date", "fact_meter_consumption", "fact_hourly_consumption", "fact_daily_consumption",
    "fact_monthly_consumption", "fact_peak_offpeak", "fact_weather_energy", "energy_summary",
]

REQUESTS = f"""requests AS (
  SELECT CASE WHEN c_custkey % 53 = 5 THEN 'soon' ELSE
      {text_ts("TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey * 7 % 720 AS INTEGER))")} END AS "timestamp",
    CASE WHEN c_custkey % 41 <> 7 THEN {meter_number('c_custkey % 400')} END AS meter_id,
    CASE WHEN c_custkey % 37 <> 4 THEN CAST(c_custkey % 40 AS DOUBLE) END AS temperature,
    c_custkey % 37 = 4 AS warm, c_custkey % 31 = 9 AS high,
    CASE WHEN c_custkey % 29 <> 3 THEN CAST(20 + c_custkey % 60 AS DOUBLE) END AS humidity,
    CASE WHEN c_custkey % 11 = 0 THEN CAST(c_custkey % 10 AS DOUBLE) END AS lag_24h
  FROM customer),
latest AS (SELECT * FROM ml_features QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY "timestamp" DESC) = 1),
judged AS (
  SELECT r.*, CASE
      WHEN r."timestamp" IS NULL OR r.meter_id IS NULL OR r.humidity IS NULL THEN 'missing: ' ||
        concat_ws(',', CASE WHEN r."timestamp" IS NULL THEN 'timestamp' END, CASE WHEN r.meter_id IS NULL THEN 'meter_id' END,
          CASE WHEN r.humidity IS NULL THEN 'humidity' END)
      WHEN r."timestamp" = 'soon' THEN 'timestamp not readable'
      WHEN r.warm OR r.high THEN 'not a number: ' || concat_ws(',', CASE WHEN r.warm THEN 'temperature' END, CASE WHEN r.high THEN 'voltage' END)
      WHEN l.meter_id IS NULL THEN 'unknown meter'
      WHEN coalesce(r.lag_24h, l.lag_24h) IS NULL
        OR NOT ({' AND '.join(f'l.{c} IS NOT NULL' for c in HISTORY_NAMES if c != 'lag_24h')}) THEN 'history too short'
    END AS reason, coalesce(r.lag_24h, l.lag_24h) AS yesterday
  FROM requests r LEFT JOIN latest l ON r.meter_id = l.meter_id)
"""


CATALOG = {
    "bronze_energy_readings": "bronze", "dim_meter_info": "meters", "dim_weather": "weather", "silver_energy_readings": "silver",
    "gold_hourly_consumption": "hourly_consumption", "gold_daily_consumption": "daily_consumption",
    "gold_monthly_consumption": "monthly_consumption", "gold_meter_consumption": "meter_consumption",
    "gold_peak_offpeak_consumption": "peak_offpeak_consumption", "gold_weather_energy": "weather_energy",
    "gold_predictions": "predictions",
}


def count_rows(label: str, sources: dict[str, str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{name}' AS {label}, count(*) AS row_count FROM {source}" for name, source in sources.items())


# The star schema's columns and types as a catalog shows them.
COLUMNS = """
dim_date date_key date, year smallint, quarter smallint, month smallint, month_name varchar(16), day smallint, day_of_week smallint, day_name varchar(16), weekend_flag smallint, season varchar(16)
dim_meter meter_id varchar(16), meter_type varchar(32), region varchar(32), installation_date date, rated_voltage decimal(6,2), base_load_kwh decimal(10,4), avg_consumption decimal(12,4), total_consumption decimal(16,4)
energy_summary total_consumption decimal(18,3), avg_consumption decimal(12,4), peak_consumption decimal(12,4), min_consumption decimal(12,4), meter_count int, reading_count bigint, period_start timestamp, period_end timestamp, refreshed_at timestamp
fact_anomalies reading_ts timestamp, meter_id varchar(16), energy_consumption decimal(12,4), anomaly_flag smallint, anomaly_type varchar(32), anomaly_score decimal(12,4), anomaly_severity varchar(16), detection_method varchar(32), created_at timestamp
fact_daily_consumption date_key date, meter_id varchar(16), total_consumption decimal(12,4), avg_consumption decimal(12,4), max_consumption decimal(12,4), min_consumption decimal(12,4), reading_count int, avg_temperature decimal(6,2), weekend_flag smallint, season varchar(16)
fact_hourly_consumption date_key date, hour smallint, meter_id varchar(16), total_consumption decimal(12,4), avg_consumption decimal(12,4), max_consumption decimal(12,4), min_consumption decimal(12,4), reading_count int, avg_temperature decimal(6,2), peak_hour_flag smallint
fact_meter_consumption meter_id varchar(16), meter_type varchar(32), region varchar(32), total_consumption decimal(16,4), avg_consumption decimal(12,4), max_consumption decimal(12,4), min_consumption decimal(12,4), stddev_consumption decimal(12,4), reading_count int, consumption_rank int
fact_monthly_consumption year smallint, month smallint, meter_id varchar(16), total_consumption decimal(14,4), avg_consumption decimal(12,4), max_consumption decimal(12,4), min_consumption decimal(12,4), reading_count int
fact_peak_offpeak date_key date, tariff_period varchar(16), total_consumption decimal(14,4), avg_consumption decimal(12,4), reading_count int
fact_predictions reading_ts timestamp, meter_id varchar(16), actual_consumption decimal(12,4), predicted_consumption decimal(12,4), prediction_error decimal(12,4), abs_percentage_error decimal(12,4), model_name varchar(64), model_version varchar(32), created_at timestamp
fact_weather_energy date_key date, weather_condition varchar(32), temperature_band varchar(16), avg_temperature decimal(6,2), avg_humidity decimal(6,2), total_consumption decimal(14,4), avg_consumption decimal(12,4), reading_count int
"""


def column_rows() -> str:
    rows = []
    for line in COLUMNS.split("\n")[1:-1]:
        table, columns = line.split(" ", 1)
        rows += [f"('{table}', {k}, '{c.split()[0]}', '{c.split()[1]}')" for k, c in enumerate(columns.split(", "))]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(table_name, place, column_name, data_type)"


def readiness_rows() -> str:
    tests = {
        ("wide_fact", "total_known"): "wide_fact WHERE total_consumption IS NULL",
        ("wide_fact", "anomaly_flag_domain"): "wide_fact WHERE anomaly_flag IS NULL OR anomaly_flag NOT IN (0, 1)",
        ("wide_fact", "severity_domain"): "wide_fact WHERE anomaly_severity IS NULL OR anomaly_severity NOT IN ('none', 'low', 'medium', 'high')",
        ("predictions", "prediction_known"): "predictions WHERE predicted_consumption IS NULL",
        ("anomalies", "flagged"): "anomalies WHERE anomaly_flag IS DISTINCT FROM 1",
        ("wide_fact", "unique_hour"): "(SELECT 1 FROM wide_fact GROUP BY date, hour, meter_id HAVING count(*) > 1)",
        ("wide_fact", "meter_known"): "wide_fact f WHERE meter_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM meters m WHERE m.meter_id = f.meter_id)",
    }
    return "\nUNION ALL ".join(
        f"SELECT '{d}' AS dataset, '{rule}' AS rule, count(*) AS violations FROM {source}" for (d, rule), source in tests.items()
    )


def statements() -> dict[str, str]:
    bodies = {
        "src_raw_csv": "SELECT * EXCLUDE (arrived_at) FROM readings",
        "bronze_readings": "SELECT * FROM bronze",
        "bronze_weather": "SELECT * FROM weather",
        "dq_report": dq_report("bronze"),
        "dq_report_silver": dq_report("silver"),
        "silver_dedup": "SELECT * FROM deduped",
        "silver_valid_rows": "SELECT * FROM bronze WHERE \"timestamp\" IS NOT NULL AND regexp_matches(meter_id, '^MTR-[0-9]{3}$')",
        "silver_bounds": f"SELECT * EXCLUDE (energy_consumption, voltage, current, power_factor), {', '.join(inside(c) for c in BOUNDS)} FROM bronze",
        "silver_impute": "SELECT * FROM filled",
        "silver_normalise": """SELECT * EXCLUDE (weather_condition, meter_type),
          upper(left(trim(coalesce(weather_condition, 'unknown')), 1))
            || lower(substr(trim(coalesce(weather_condition, 'unknown')), 2)) AS weather_condition,
          lower(trim(meter_type)) AS meter_type FROM bronze""",
        "silver_enrich": f"SELECT * EXCLUDE (season, tariff_period), {CALENDAR} FROM bronze",
        "silver": "SELECT * FROM silver",
        "gold_hourly": "SELECT * FROM hourly_consumption",
        "gold_daily": "SELECT * FROM daily_consumption",
        "gold_weekly": "SELECT * FROM weekly_consumption",
        "gold_weekly_iso": f'SELECT CAST(isoyear("timestamp") AS INTEGER) AS year, CAST(weekofyear("timestamp") AS INTEGER) AS week_of_year, meter_id, {TOT_AVG}, {N} FROM silver GROUP BY ALL',
        "gold_monthly": "SELECT * FROM monthly_consumption",
        "gold_meter": "SELECT * FROM meter_consumption",
        "gold_peak_offpeak": "SELECT * FROM peak_offpeak_consumption",
        "gold_weather": "SELECT * FROM weather_energy",
        "gold_summary": "SELECT * FROM energy_summary",
        "gold_dim_date": "SELECT * FROM dim_date",
        "gold_dim_meter": "SELECT * FROM dim_meter",
        "feat_lags": f'SELECT "timestamp", meter_id, {E}, lag_1h, lag_2h, lag_3h, lag_24h FROM ml_features',
        "feat_rolling": f'SELECT "timestamp", meter_id, {E}, {", ".join(HISTORY_NAMES[4:])} FROM ml_features',
        "ml_features": "SELECT * FROM ml_features",
        "feat_lags_if_absent": f'SELECT "timestamp", meter_id, {", ".join(HISTORY_NAMES)} FROM (SELECT "timestamp", meter_id, {history(BY_METER, True)} FROM silver)',
        "feat_cyclical": f'SELECT "timestamp", meter_id, {CYCLES} FROM silver',
        "feat_matrix": f'SELECT "timestamp", meter_id, {E}, {MATRIX} FROM complete',
        "ml_split": f"""SELECT "timestamp", meter_id, {E}, CASE WHEN place > floor(n * CAST(0.8 AS DOUBLE)) THEN 'test' ELSE 'train' END AS part
          FROM placed""",
        "ml_metrics": f"""SELECT {rnd('mae', 5)} AS mae, {rnd('mse', 5)} AS mse, {rnd('sqrt(mse)', 5)} AS rmse,
          {rnd('1 - mse / spread', 5)} AS r2 FROM (
            SELECT {mean('abs(predicted_consumption - actual_consumption)')} AS mae,
              {mean('(predicted_consumption - actual_consumption) * (predicted_consumption - actual_consumption)')} AS mse,
              var_pop(actual_consumption) AS spread FROM predictions)""",
        "predictions": "SELECT * FROM predictions",
        "prediction_summary": f"SELECT count(*) AS rows, {rnd(mean('abs(prediction_error)'), 5)} AS mae, {rnd(mean('abs_percentage_error'), 5)} AS mape FROM predictions",
        "predict_frame": f"""SELECT "timestamp", meter_id, {rnd('lag_24h', 4)} AS predicted_consumption,
          'Persistence' AS model_name, '1.0.0' AS model_version FROM complete""",
        "anom_zscore": "SELECT * FROM zscore",
        "anom_severity": "SELECT * FROM scored",
        "ml_train_contract": f"""SELECT m.model_name, t.train_rows, n.n - t.train_rows AS test_rows,
          CAST({len(MODEL_NUMBERS) + len(HISTORY_NAMES) + 2 * len(WAVES)} + t.levels AS INTEGER) AS feature_count,
          true AS selected_is_best, CAST(1 AS BIGINT) AS selected_models
          FROM (VALUES ('LinearRegression'), ('RandomForest'), ('GradientBoosting')) m(model_name),
            (SELECT count(*) AS n FROM complete) n,
            (SELECT count(*) AS train_rows, count(DISTINCT meter_type) + count(DISTINCT season)
              + count(DISTINCT weather_condition) AS levels FROM placed WHERE place <= floor(n * CAST(0.8 AS DOUBLE))) t""",
        "predictions_fitted_keys": f"""SELECT "timestamp", meter_id, {rnd(E, 4)} AS actual_consumption, true AS error_follows,
          true AS percentage_is_size FROM holdout""",
        "anom_iforest_contract": f"""SELECT "timestamp", meter_id, {E}, true AS flag_follows, true AS score_in_range,
          true AS type_follows FROM silver""",
        "anomalies_contract": """SELECT unnest(['robust_zscore', 'isolation_forest']) AS detection_method, count(*) AS rows,
          CAST(0 AS BIGINT) AS wrong_severity FROM silver""",
        "anom_summary": """SELECT 'type' AS facet, anomaly_type AS label, count(*) AS anomalies FROM anomalies GROUP BY anomaly_type
          UNION ALL SELECT 'severity', anomaly_severity, count(*) FROM anomalies GROUP BY anomaly_severity""",
        "anomalies_fact": "SELECT * FROM fact_anomalies",
        "wide_fact": "SELECT * FROM wide_fact",
        "wide_fact_summary": "SELECT count(*) AS rows, CAST(sum(anomaly_flag) AS BIGINT) AS anomaly_rows, count(predicted_consumption) AS predicted_rows FROM wide_fact",
        "calc_columns": f"""SELECT *, CASE WHEN peak_hour_flag = 1 THEN 'Peak' ELSE 'Off-Peak' END AS tariff_label, {HOUR_LABEL},
          CASE WHEN total_consumption < 2 THEN 'Low' WHEN total_consumption < 6 THEN 'Medium'
            WHEN total_consumption < 12 THEN 'High' ELSE 'Very High' END AS consumption_band, {ANOMALY_LABEL} FROM wide_fact""",
        "calc_columns_dim_date": """SELECT *, strftime(date, '%b %Y') AS month_year,
          CASE WHEN weekend_flag = 1 THEN 'Weekend' ELSE 'Weekday' END AS is_weekend FROM dim_date""",
        "calc_columns_predictions": "SELECT *, abs(prediction_error) AS absolute_error FROM predictions",
        "vw_energy_summary": f"{SUMMARY} FROM fact_daily_consumption",
        "vw_daily_trend": f"SELECT date_key, {V_TOT}, {V_AVG}, {V_EXT}, {mean('avg_temperature')} AS avg_temperature FROM fact_daily_consumption GROUP BY date_key",
        "vw_monthly_trend": f"SELECT year, month, {V_TOT}, {V_AVG} FROM fact_monthly_consumption GROUP BY year, month",
        "vw_hourly_pattern": f"SELECT hour, {V_AVG}, {V_TOT}, max(peak_hour_flag) AS peak_hour_flag FROM fact_hourly_consumption GROUP BY hour",
        "vw_meter_ranking": RANKING,
        "vw_top_meters": f"SELECT * FROM ({RANKING}) WHERE consumption_rank <= 5",
        "vw_peak_offpeak": f"""SELECT *, {rnd('100.0 * total_consumption / nullif(' + rnd('sum(total_consumption) OVER ()', 4) + ', 0)', 2)} AS pct_of_total FROM (
          SELECT tariff_period, {V_TOT}, {V_AVG}, CAST(sum(reading_count) AS BIGINT) AS reading_count
          FROM fact_peak_offpeak GROUP BY tariff_period)""",
        "vw_weekday_weekend": f"SELECT CASE WHEN weekend_flag = 1 THEN 'weekend' ELSE 'weekday' END AS day_group, {V_TOT}, {V_AVG} FROM fact_daily_consumption GROUP BY weekend_flag",
        "vw_seasonal_consumption": f"SELECT season, {V_TOT}, {V_AVG} FROM fact_daily_consumption GROUP BY season",
        "vw_weather_impact": f"SELECT weather_condition, temperature_band, {mean('avg_temperature')} AS avg_temperature, {mean('avg_humidity')} AS avg_humidity, {V_TOT}, {V_AVG} FROM fact_weather_energy GROUP BY weather_condition, temperature_band",
        "vw_anomaly_counts": """SELECT CAST(reading_ts AS DATE) AS date_key, count(*) FILTER (WHERE anomaly_flag = 1) AS anomaly_count,
          count(*) FILTER (WHERE anomaly_severity = 'high') AS high_severity_count,
          count(*) FILTER (WHERE anomaly_severity = 'medium') AS medium_severity_count,
          count(*) FILTER (WHERE anomaly_severity = 'low') AS low_severity_count FROM fact_anomalies GROUP BY 1""",
        "vw_anomaly_by_meter": f"""SELECT meter_id, count(*) AS anomaly_count, {mean('anomaly_score')} AS avg_anomaly_score,
          max({E}) AS max_anomalous_consumption FROM fact_anomalies WHERE anomaly_flag = 1 GROUP BY meter_id""",
        "vw_prediction_accuracy": ACCURACY,
        "vw_actual_vs_predicted": ACTUAL_PREDICTED,
        "read_summary": f"{SUMMARY}, (SELECT count(*) FROM fact_anomalies) AS total_anomalies FROM fact_daily_consumption",
        "read_daily": f"SELECT date_key, {V_TOT}, {V_AVG}, {V_EXT}, {mean('avg_temperature')} AS avg_temperature FROM fact_daily_consumption GROUP BY date_key ORDER BY date_key DESC LIMIT 90",
        "read_daily_meter": """SELECT date_key, meter_id, total_consumption, avg_consumption, max_consumption, min_consumption, avg_temperature
          FROM fact_daily_consumption WHERE meter_id = 'MTR-007' ORDER BY date_key DESC LIMIT 30""",
        "read_monthly": f"SELECT year, month, {V_TOT}, {V_AVG} FROM fact_monthly_consumption GROUP BY year, month",
        "read_hourly": f"SELECT hour, {V_AVG}, {V_TOT}, max(peak_hour_flag) AS peak_hour_flag FROM fact_hourly_consumption GROUP BY hour",
        "read_meters": RANKING,
        "read_meter": f"SELECT * FROM ({RANKING}) WHERE meter_id = 'MTR-007'",
        "read_anomalies": "SELECT * FROM fact_anomalies ORDER BY reading_ts DESC, meter_id, detection_method LIMIT 100",
        "read_anomalies_high": "SELECT * FROM fact_anomalies WHERE anomaly_severity = 'high' ORDER BY reading_ts DESC, meter_id, detection_method LIMIT 50",
        "read_predictions": f"{ACTUAL_PREDICTED} ORDER BY reading_ts DESC, meter_id, model_name LIMIT 100",
        "read_predictions_meter": f"{ACTUAL_PREDICTED} WHERE meter_id = 'MTR-007' ORDER BY reading_ts DESC LIMIT 100",
        "read_accuracy": ACCURACY,
        "metrics_global": f"SELECT {measures()} FROM wide_fact",
        "metrics_by_month": f"SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, {measures()} FROM wide_fact GROUP BY 1",
        "metrics_sliced": f"""SELECT d.region, {measures(['total_energy_consumption', 'meter_count', 'total_anomalies', 'anomaly_rate_pct'])}
          FROM wide_fact w JOIN (SELECT meter_id AS id, region, meter_type FROM meters) d ON w.meter_id = d.id
          WHERE w.date BETWEEN TIMESTAMP '2023-03-01' AND TIMESTAMP '2023-08-31' AND d.meter_type IN ('residential', 'industrial')
          GROUP BY d.region""",
        "metrics_mom": f"""WITH months AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, {total('total_consumption')} AS total_energy_consumption
            FROM wide_fact GROUP BY 1)
          SELECT a.month_start, a.total_energy_consumption, b.total_energy_consumption AS previous_month,
            {pct('(a.total_energy_consumption - b.total_energy_consumption)', 'b.total_energy_consumption')} AS consumption_mom_pct
          FROM months a LEFT JOIN months b ON a.month_start = b.month_start + INTERVAL 1 MONTH""",
        "metrics_rolling_7d": f"""WITH days AS (SELECT CAST(date AS DATE) AS day, {total('total_consumption')} AS total_energy_consumption FROM wide_fact GROUP BY 1)
          SELECT a.day, a.total_energy_consumption, (SELECT {total('b.total_energy_consumption')} FROM days b
            WHERE b.day BETWEEN a.day - 6 AND a.day) AS rolling_7d_consumption FROM days a""",
        "metrics_predictions": f"""SELECT {mean('abs(prediction_error)')} AS prediction_mae,
          sqrt({mean('prediction_error * prediction_error')}) AS prediction_rmse, {mean('abs_percentage_error')} AS prediction_mape_pct FROM predictions""",
        "rep_temp_band": f"SELECT temperature_band, {measures(['average_temperature', 'average_consumption'])} FROM wide_fact GROUP BY temperature_band",
        "rep_top_meters": f"SELECT meter_id, {measures(['total_energy_consumption'])} FROM wide_fact GROUP BY meter_id ORDER BY total_energy_consumption DESC, meter_id LIMIT 5",
        "rep_meter_trend": f"SELECT date, meter_id, {measures(['total_energy_consumption'])} FROM wide_fact GROUP BY date, meter_id",
        "rep_meter_season": "SELECT meter_id, " + ", ".join(f"{when_total(f'season = {chr(39)}{s}{chr(39)}')} AS \"{s}\"" for s in ("Winter", "Spring", "Summer", "Autumn")) + " FROM wide_fact GROUP BY meter_id",
        "rep_drill": f"""SELECT region, meter_type, meter_id, CAST(grouping(region, meter_type, meter_id) AS INTEGER) AS depth,
          {total('total_consumption')} AS total_consumption, CAST(sum(reading_count) AS BIGINT) AS reading_count
          FROM meter_consumption GROUP BY ROLLUP (region, meter_type, meter_id)""",
        "rep_anomaly_type": "SELECT anomaly_type, count(*) AS anomalies FROM anomalies GROUP BY anomaly_type",
        "rep_anomaly_timeline": 'SELECT "timestamp", count(*) AS anomalies FROM anomalies GROUP BY "timestamp"',
        "rep_high_periods": f"""SELECT date, {HOUR_LABEL}, meter_id, total_consumption, {ANOMALY_LABEL} FROM wide_fact
          ORDER BY total_consumption DESC, date, hour_label, meter_id LIMIT 100""",
        "wh_constraints": constraint_rows(),
        "sink_bronze_days": "SELECT event_date, count(*) AS rows FROM bronze GROUP BY event_date",
        "sink_silver_days": "SELECT date, count(*) AS rows FROM silver GROUP BY date",
        "sink_gold_csv": "SELECT * FROM daily_consumption",
        "dq_strict": " UNION ALL ".join(f"SELECT layer, NOT passed AS raised, failures FROM ({dq_report(x)})" for x in ("bronze", "silver")),
        "gold_readiness": readiness_rows(),
        "batch_rows": count_rows(
            "dataset", {n: n for n in (*PROFILES, "ml_features") if n != "anomalies"} | {"anomalies:robust_zscore": "anomalies"}
        ),
        "catalog_rows": count_rows(
            "table_name",
            CATALOG | {n: sql_name(n) for n in WAREHOUSE} | {"fact_predictions": "fact_predictions"}
            | {f"{n}_anomalies:robust_zscore": "anomalies" for n in ("gold", "fact")},
        ),
        "catalog_columns": column_rows(),
        "fk_orphans": """SELECT f.meter_id AS value, count(*) AS rows FROM fact_daily_consumption f
          LEFT JOIN dim_meter d ON f.meter_id = d.meter_id WHERE d.meter_id IS NULL GROUP BY f.meter_id""",
        "rel_check": relationship_rows(),
    }
    bodies["rep_daily_rolling"] = bodies["metrics_rolling_7d"]
    for name in PROFILES:
        bodies[f"profile_{name}"] = profile_rows(name)
    for table in WAREHOUSE:
        bodies[f"wh_{table}"] = f"SELECT * FROM {sql_name(table)}"
    bodies["wh_fact_predictions"] = "SELECT * FROM fact_predictions"
    found = {name: f"WITH {CTES}\n{_inlined(body)}" for name, body in bodies.items()}
    found["predict_requests"] = f"""WITH {CTES},\n{REQUESTS}
      SELECT CAST("timestamp" AS TIMESTAMP) AS "timestamp", meter_id, {rnd('yesterday', 4)} AS predicted_consumption,
        'Persistence' AS model_name, '1.0.0' AS model_version FROM judged WHERE reason IS NULL"""
    found["predict_requests_rejected"] = f"""WITH {CTES},\n{REQUESTS}
      SELECT "timestamp", meter_id, reason FROM judged WHERE reason IS NOT NULL"""
    return found


def _inlined(body: str) -> str:
    """A body that brings its own CTE continues the common list."""
    if body.startswith("WITH "):
        name, rest = body[5:].split(" AS (", 1)
        return f", {name} AS ({rest}"
    return body
