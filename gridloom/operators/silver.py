"""Bronze to silver: one trusted, complete, enriched row per meter and timestamp."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.functions.aggregates import mean
from gridloom.settings import DEFAULTS, Settings

KEY = ("meter_id", "timestamp")


def latest_arrival(bronze: DataFrame) -> DataFrame:
    """Keep the last row to arrive per meter and timestamp.

    The remaining columns break ties, so equal arrival times still give one answer. Spark keeps
    the first row per key before the shuffle as well, so a key sent millions of times moves once
    per task.
    """
    others = [c for c in bronze.columns if c not in (*KEY, "ingestion_ts")]
    newest = Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in ("ingestion_ts", *others)])
    return bronze.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def usable_rows(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    meter = F.col("meter_id")
    return df.where(
        F.col("timestamp").isNotNull() & meter.isNotNull() & meter.rlike(settings.meter_id_pattern)
    )


def without_impossible_values(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).between(*limits), F.col(c)) for c, limits in bounds.items()})


def filled_with_meter_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace NULL by the meter's mean; a meter without any value keeps NULL.

    The means are pre-aggregated per task and joined back, so a meter with very many rows is never
    gathered in one place; adaptive execution broadcasts the means when they turn out small and
    splits heavy meters when they do not.
    """
    means = df.groupBy("meter_id").agg(*[mean(c).alias(f"_mean_{c}") for c in columns])
    filled = {c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in columns}
    return df.join(means, "meter_id", "left").withColumns(filled).drop(*[f"_mean_{c}" for c in columns])


def normalised_labels(df: DataFrame) -> DataFrame:
    weather = F.coalesce(F.col("weather_condition"), F.lit("unknown"))
    return df.withColumns(
        {
            "weather_condition": F.initcap(F.trim(weather)),
            "meter_type": F.lower(F.trim(F.col("meter_type"))),
        }
    )


def cleaned(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    bounded = without_impossible_values(usable_rows(df, settings), settings.bounds)
    return normalised_labels(filled_with_meter_means(bounded, settings.imputed)).dropna(
        subset=["energy_consumption"]
    )


def enriched(df: DataFrame) -> DataFrame:
    at = F.col("timestamp")
    parts = {
        "date": F.to_date(at),
        "year": F.year(at),
        "month": F.month(at),
        "day": F.dayofmonth(at),
        "hour": F.hour(at),
        "minute": F.minute(at),
        "day_of_week": F.dayofweek(at),
        "weekend_flag": calendar.weekend_flag(at),
        "peak_hour_flag": calendar.peak_hour_flag(at),
        "season": calendar.season(F.month(at)),
        "temperature_band": calendar.temperature_band(F.col("temperature")),
        "tariff_period": calendar.tariff_period(calendar.peak_hour_flag(at)),
    }
    return df.withColumns(parts)


def to_silver(bronze: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Deduplicate first, then clean: the last arrival counts even if it is unusable."""
    return enriched(cleaned(latest_arrival(bronze), settings))
