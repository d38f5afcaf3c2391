"""Parameterised read queries. Top-k reads have a total order, so equal timestamps do not flicker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import views
from gridloom.settings import MAX_READ_LIMIT

SEVERITIES = ("low", "medium", "high")


class NotFound(LookupError):
    """Nothing is known about the requested meter."""


def checked_limit(limit: int | str) -> int:
    try:
        value = int(limit)
    except (TypeError, ValueError) as problem:
        raise ValueError(f"{limit!r} is no number of rows") from problem
    if not 1 <= value <= MAX_READ_LIMIT:
        raise ValueError(f"a read returns 1 to {MAX_READ_LIMIT} rows, not {value}")
    return value


def read_summary(daily: DataFrame, anomalies: DataFrame) -> DataFrame:
    flagged = anomalies.where(F.col("anomaly_flag") == 1).agg(F.count(F.lit(1)).alias("n"))
    return views.energy_summary(daily).withColumn("total_anomalies", flagged.scalar())


def read_daily(daily: DataFrame, meter_id: str | None = None, limit: int | str = 90) -> DataFrame:
    """Newest days first: the overall trend, or the days of one meter."""
    count = checked_limit(limit)
    if meter_id is None:
        chosen = views.daily_trend(daily)
    else:
        chosen = daily.where(F.col("meter_id") == meter_id).select(
            "date_key", "meter_id", "total_consumption", "avg_consumption", "max_consumption",
            "min_consumption", "avg_temperature",
        )
    return chosen.orderBy(F.desc("date_key")).limit(count)


def read_monthly(monthly: DataFrame) -> DataFrame:
    return views.monthly_trend(monthly)


def read_hourly(hourly: DataFrame) -> DataFrame:
    return views.hourly_pattern(hourly)


def read_meters(meters: DataFrame) -> DataFrame:
    return views.meter_ranking(meters)


def read_meter(meters: DataFrame, meter_id: str, *, must_exist: bool = False) -> DataFrame:
    """One meter of the ranking. ``must_exist`` looks it up at once and raises if unknown."""
    if must_exist and meters.where(F.col("meter_id") == meter_id).isEmpty():
        raise NotFound(meter_id)
    return views.meter_ranking(meters).where(F.col("meter_id") == meter_id)


def _newest(df: DataFrame, count: int, *ties: Column | str) -> DataFrame:
    return df.orderBy(F.desc("reading_ts"), *ties).limit(count)


def read_anomalies(
    anomalies: DataFrame,
    meter_id: str | None = None,
    severity: str | None = None,
    limit: int | str = 100,
) -> DataFrame:
    count = checked_limit(limit)
    if severity is not None and severity not in SEVERITIES:
        raise ValueError(f"{severity!r} is no severity; known: {', '.join(SEVERITIES)}")
    chosen = anomalies.where(F.col("anomaly_flag") == 1)
    if meter_id is not None:
        chosen = chosen.where(F.col("meter_id") == meter_id)
    if severity is not None:
        chosen = chosen.where(F.col("anomaly_severity") == severity)
    return _newest(chosen, count, "meter_id", "detection_method")


def read_predictions(
    predictions: DataFrame, meter_id: str | None = None, limit: int | str = 100
) -> DataFrame:
    count = checked_limit(limit)
    chosen = predictions if meter_id is None else predictions.where(F.col("meter_id") == meter_id)
    return _newest(views.actual_vs_predicted(chosen), count, "meter_id", "model_name")


def read_accuracy(predictions: DataFrame) -> DataFrame:
    return views.prediction_accuracy(predictions)
