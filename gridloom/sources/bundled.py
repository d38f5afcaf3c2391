"""Feeds derived from the driver's ``events`` and ``customer`` tables.

The rules (``FIXTURES.md`` section 3) stretch thirty days of events over one year and add dirt by
event id, so that every cleaning rule has something to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.sources import schemas
from gridloom.sources.feeds import Feeds

# Fixed values of the mapping.
SOURCE_ORIGIN_MICROS = 1704067200000000
TARGET_ORIGIN_MICROS = 1672531200000000
STRETCH = 12


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# SQL texts rather than column calls: one round trip to the JVM per feed instead of hundreds.
_HOUR_START = (
    f"date_trunc('hour', timestamp_micros({TARGET_ORIGIN_MICROS} + {STRETCH} * "
    f"(unix_micros(cast(ts AS timestamp)) - {SOURCE_ORIGIN_MICROS})))"
)
_AS_TEXT = "date_format({0}, 'yyyy-MM-dd HH:mm:ss')"
_METER_ID = "concat('MTR-', CASE WHEN {0} < 1000 THEN lpad(cast({0} AS string), 3, '0') ELSE cast({0} AS string) END)"
_REGIONS = ("North", "South", "East", "West")


def _pick(number: str, labels: tuple[str, ...]) -> str:
    """The label at the remainder of ``number``."""
    branches = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels))
    return f"CASE {number} % {len(labels)} {branches} END"


READING_RULES = {
    "timestamp": f"CASE WHEN event_id % 211 = 3 THEN 'bad-ts' ELSE {_AS_TEXT.format(_HOUR_START)} END",
    "meter_id": f"CASE WHEN event_id % 101 = 7 THEN 'BAD-ID' ELSE {_METER_ID.format('user_id')} END",
    "meter_type": _pick("user_id", ("residential", " Commercial", "INDUSTRIAL ")),
    "region": _pick("user_id", _REGIONS),
    "energy_consumption": "CASE WHEN event_id % 97 != 5 THEN value END",
    "voltage": "cast(get_json_object(props, '$.k') AS double) + 178",
    "current": "round(value / 2.3D, 3)",
    "power_factor": "(45 + event_id % 58) / 100",
    "temperature": "CASE WHEN event_id % 37 != 0 THEN (event_id * 7) % 45 - 5 END",
    "humidity": "15 + (event_id * 11) % 85",
    "weather_condition": (
        "CASE event_type WHEN 'click' THEN ' clear' WHEN 'view' THEN 'CLOUDY ' "
        "WHEN 'purchase' THEN 'Rain' WHEN 'signup' THEN 'fog' END"
    ),
    "is_peak_hour": "NULL",
    "tariff_period": "NULL",
    "hvac_kwh": "value * 0.35D",
    "lighting_kwh": "value * 0.12D",
    "appliance_kwh": "value * 0.53D",
    "injected_anomaly": "0",
    "injected_anomaly_type": "'none'",
    "season": "NULL",
}


def _typed(rules: dict[str, str], schema: StructType) -> list[str]:
    return [f"cast({rules[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema]


def readings(events: DataFrame) -> DataFrame:
    """Raw readings plus ``arrived_at``, the original event time."""
    return events.selectExpr(*_typed(READING_RULES, schemas.READINGS), "cast(ts AS timestamp) AS arrived_at")


METER_RULES = {
    "meter_id": _METER_ID.format("c_custkey"),
    "meter_type": _pick("c_custkey", ("residential", "commercial", "industrial")),
    "region": _pick("c_custkey", _REGIONS),
    "installation_date": "date_add(DATE'2018-01-01', cast(c_custkey * 37 % 1500 AS int))",
    "rated_voltage": "230.0D",
    "base_load_kwh": "1 + (c_custkey % 7) * 0.85D",
}


def meters(customers: DataFrame) -> DataFrame:
    return customers.selectExpr(*_typed(METER_RULES, schemas.METERS))


WEATHER_RULES = {
    "timestamp": _AS_TEXT.format("at"),
    "temperature": "(dayofyear(at) * 7 + hour(at)) % 45 - 5",
    "humidity": "15 + (dayofyear(at) + hour(at)) % 85",
    "weather_condition": _pick("hour(at)", ("Clear", "Cloudy", "Rain", "Fog")),
}


def weather(events: DataFrame) -> DataFrame:
    """One row per distinct reading hour."""
    return events.selectExpr(f"{_HOUR_START} AS at").distinct().selectExpr(*_typed(WEATHER_RULES, schemas.WEATHER))


def deliveries(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The readings in two deliveries: what was superseded later on, then the last reading of every meter and time."""
    newest = Window.partitionBy("meter_id", "timestamp").orderBy(F.desc("arrived_at"))
    placed = readings(events).withColumn("_place", F.row_number().over(newest))
    return tuple(placed.where(which).drop("arrived_at", "_place") for which in ("_place > 1", "_place = 1"))


def feeds(spark: SparkSession, folder: str) -> Feeds:
    """The three feeds in their raw schemas."""
    events = table(spark, folder, "events")
    return Feeds(
        readings(events).drop("arrived_at"), meters(table(spark, folder, "customer")), weather(events)
    )
