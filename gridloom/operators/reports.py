"""Report queries behind the dashboard pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.aggregates import rows, total
from gridloom.operators import metrics, widefact
from gridloom.settings import SEASONS


def daily_with_rolling(fact: DataFrame) -> DataFrame:
    return metrics.rolling_days(fact)


def temperature_bands(fact: DataFrame) -> DataFrame:
    return metrics.measure(fact, ["average_temperature", "average_consumption"], ["temperature_band"])


def top_meters(fact: DataFrame, count: int = 5) -> DataFrame:
    """The ``count`` meters with the largest total, ties in meter order."""
    return (
        metrics.measure(fact, ["total_energy_consumption"], ["meter_id"])
        .orderBy(F.desc("total_energy_consumption"), "meter_id")
        .limit(count)
    )


def meter_trend(fact: DataFrame) -> DataFrame:
    return metrics.measure(fact, ["total_energy_consumption"], ["date", "meter_id"])


def meter_by_season(fact: DataFrame) -> DataFrame:
    """Matrix of meter and season; the seasons are known, so no pass looks for them."""
    return fact.groupBy("meter_id").pivot("season", list(SEASONS)).agg(total("total_consumption"))


def drill_down(meters: DataFrame) -> DataFrame:
    """Totals per region, type and meter with all subtotals.

    Works on one row per meter, so the copies a rollup makes are few.
    """
    return (
        meters.rollup("region", "meter_type", "meter_id")
        .agg(
            F.grouping_id().alias("depth"),
            total("total_consumption").alias("total_consumption"),
            F.sum("reading_count").alias("reading_count"),
        )
        .withColumn("depth", F.col("depth").cast("int"))
    )


def anomalies_by_type(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("anomaly_type").agg(rows().alias("anomalies"))


def anomaly_timeline(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("timestamp").agg(rows().alias("anomalies"))


def high_consumption_periods(fact: DataFrame, count: int = 100) -> DataFrame:
    return (
        widefact.labelled_fact(fact)
        .select("date", "hour_label", "meter_id", "total_consumption", "anomaly_label")
        .orderBy(F.desc("total_consumption"), "date", "hour_label", "meter_id")
        .limit(count)
    )
