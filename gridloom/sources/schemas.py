"""Explicit schemas of the raw feeds; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _schema(columns: str) -> T.StructType:
    """``name type, name type`` with every column nullable; needs no running session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in pairs])


# Column names, types and order of the three CSV feeds.
READINGS = _schema(
    "timestamp string, meter_id string, meter_type string, region string, "
    "energy_consumption double, voltage double, current double, power_factor double, "
    "temperature double, humidity double, weather_condition string, is_peak_hour int, "
    "tariff_period string, hvac_kwh double, lighting_kwh double, appliance_kwh double, "
    "injected_anomaly int, injected_anomaly_type string, season string"
)
METERS = _schema(
    "meter_id string, meter_type string, region string, installation_date string, "
    "rated_voltage double, base_load_kwh double"
)
WEATHER = _schema("timestamp string, temperature double, humidity double, weather_condition string")
FEED_FILES = {"readings": "energy_readings.csv", "meters": "meter_info.csv", "weather": "weather.csv"}
