"""Gold aggregates and dimensions over silver readings. Order is left to the reader or the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.functions.aggregates import rounded_mean, rows, total
from gridloom.functions.ordering import running_total

ENERGY = "energy_consumption"


def _measures(extremes: bool = True) -> list[Column]:
    chosen = [total(ENERGY).alias("total_consumption"), rounded_mean(ENERGY).alias("avg_consumption")]
    if extremes:
        chosen += [
            F.round(F.max(ENERGY), 4).alias("max_consumption"),
            F.round(F.min(ENERGY), 4).alias("min_consumption"),
        ]
    return [*chosen, rows().alias("reading_count")]


def _temperature() -> Column:
    return rounded_mean("temperature", 2).alias("avg_temperature")


def hourly_consumption(silver: DataFrame) -> DataFrame:
    return silver.groupBy("date", "hour", "meter_id").agg(
        *_measures(), _temperature(), F.max("peak_hour_flag").alias("peak_hour_flag")
    )


def daily_consumption(silver: DataFrame) -> DataFrame:
    """Weekend flag and season follow from the date and are derived once per row of the result."""
    return (
        silver.groupBy("date", "meter_id")
        .agg(*_measures(), _temperature())
        .withColumns({"weekend_flag": calendar.weekend_flag(F.col("date")), "season": calendar.season(F.month("date"))})
    )


def weekly_consumption(silver: DataFrame, iso_year: bool = False) -> DataFrame:
    """ISO week numbers under the calendar year, or under the ISO year on request.

    Under the calendar year, days of early January that belong to the last ISO week of the year
    before are counted with the last week of their own year.
    """
    year = F.extract(F.lit("YEAROFWEEK"), "timestamp").cast("int") if iso_year else F.col("year")
    return silver.groupBy(
        year.alias("year"), F.weekofyear("timestamp").alias("week_of_year"), "meter_id"
    ).agg(*_measures(extremes=False))


def monthly_consumption(silver: DataFrame) -> DataFrame:
    return silver.groupBy("year", "month", "meter_id").agg(*_measures())


def meter_totals(silver: DataFrame) -> DataFrame:
    return silver.groupBy("meter_id", "meter_type", "region").agg(
        *_measures(), F.round(F.stddev_samp(ENERGY), 4).alias("stddev_consumption")
    )


def meter_consumption(silver: DataFrame) -> DataFrame:
    """Per meter with a gap-free rank by total, ties in meter order."""
    meters = meter_totals(silver)
    ties = [F.col(c) for c in meters.columns if c != "total_consumption"]
    return running_total(meters, [-F.col("total_consumption"), *ties], "consumption_rank").withColumn(
        "consumption_rank", F.col("consumption_rank").cast("int")
    )


def peak_offpeak_consumption(silver: DataFrame) -> DataFrame:
    return silver.groupBy("date", "tariff_period").agg(*_measures(extremes=False))


def weather_energy(silver: DataFrame) -> DataFrame:
    return silver.groupBy("date", "weather_condition", "temperature_band").agg(
        _temperature(), rounded_mean("humidity", 2).alias("avg_humidity"), *_measures(extremes=False)
    )


def energy_summary(silver: DataFrame) -> DataFrame:
    return silver.agg(
        total(ENERGY, 3).alias("total_consumption"),
        rounded_mean(ENERGY).alias("avg_consumption"),
        F.round(F.max(ENERGY), 4).alias("peak_consumption"),
        F.round(F.min(ENERGY), 4).alias("min_consumption"),
        F.count_distinct("meter_id").alias("meter_count"),
        rows().alias("reading_count"),
        F.min("timestamp").alias("period_start"),
        F.max("timestamp").alias("period_end"),
    )


def dim_date(silver: DataFrame) -> DataFrame:
    """Every column follows from the date, so only dates are made distinct."""
    return (
        silver.select("date")
        .distinct()
        .withColumns(
            {
                "year": F.year("date"),
                "month": F.month("date"),
                "day": F.dayofmonth("date"),
                "day_of_week": F.dayofweek("date"),
                "weekend_flag": calendar.weekend_flag(F.col("date")),
                "season": calendar.season(F.month("date")),
                "month_name": F.date_format("date", "MMMM"),
                "day_name": F.date_format("date", "EEEE"),
                "quarter": F.quarter("date"),
            }
        )
    )


def dim_meter(silver: DataFrame, meters: DataFrame) -> DataFrame:
    """Every known meter, with its consumption where it has readings."""
    usage = silver.groupBy("meter_id").agg(
        rounded_mean(ENERGY).alias("avg_consumption"), total(ENERGY).alias("total_consumption")
    )
    return meters.join(usage, "meter_id", "left")


#: Data sets made of silver readings alone.
DATASETS = {
    make.__name__: make
    for make in (
        energy_summary, hourly_consumption, daily_consumption, weekly_consumption, monthly_consumption,
        meter_consumption, peak_offpeak_consumption, weather_energy, dim_date,
    )
}
