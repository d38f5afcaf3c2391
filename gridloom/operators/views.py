"""The fourteen analytical views over the warehouse tables.

Averages of averages are unweighted on purpose. Inputs are values rounded to four digits, so
their sums are rounded to four digits as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.aggregates import mean, rows, total
from gridloom.functions.ordering import running_total


def _consumed() -> Column:
    return total("total_consumption").alias("total_consumption")


def _typical(name: str = "avg_consumption") -> Column:
    return mean("avg_consumption").alias(name)


def _extremes() -> list[Column]:
    return [
        F.max("max_consumption").alias("max_consumption"),
        F.min("min_consumption").alias("min_consumption"),
    ]


def energy_summary(daily: DataFrame) -> DataFrame:
    return daily.agg(
        _consumed(),
        _typical("average_consumption"),
        *_extremes(),
        F.count_distinct("meter_id").alias("meter_count"),
        F.sum("reading_count").alias("reading_count"),
        F.min("date_key").alias("period_start"),
        F.max("date_key").alias("period_end"),
    )


def daily_trend(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date_key").agg(
        _consumed(), _typical(), *_extremes(), mean("avg_temperature").alias("avg_temperature")
    )


def monthly_trend(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("year", "month").agg(_consumed(), _typical())


def hourly_pattern(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("hour").agg(
        _typical(), _consumed(), F.max("peak_hour_flag").alias("peak_hour_flag")
    )


def meter_ranking(meters: DataFrame) -> DataFrame:
    """Meters with their rank inside the region; equal totals share a rank.

    The number of meters ahead is counted over distinct totals per region, in slots of the order,
    so a region with most of the meters is not sorted in one task.
    """
    levels = meters.groupBy("region", "total_consumption").agg(rows().alias("_tied"))
    ahead = running_total(
        levels, [-F.col("total_consumption")], "_upto", within=["region"], weight=F.col("_tied")
    ).select(
        F.col("region").alias("_region"),
        F.col("total_consumption").alias("_total"),
        (F.col("_upto") - F.col("_tied") + 1).cast("int").alias("region_rank"),
    )
    same = F.col("region").eqNullSafe(F.col("_region")) & (F.col("total_consumption") == F.col("_total"))
    return meters.join(ahead, same).select(
        "meter_id", "meter_type", "region", "total_consumption", "avg_consumption", "max_consumption",
        "min_consumption", "consumption_rank", "region_rank",
    )


def top_meters(meters: DataFrame, count: int = 5) -> DataFrame:
    return meter_ranking(meters).where(F.col("consumption_rank") <= count)


def peak_offpeak(peak: DataFrame) -> DataFrame:
    """The share needs the overall total, taken over the one row per tariff."""
    tariffs = peak.groupBy("tariff_period").agg(
        _consumed(), _typical(), F.sum("reading_count").alias("reading_count")
    )
    whole = tariffs.agg(total("total_consumption").alias("whole"))
    percent = F.try_divide(100.0 * F.col("total_consumption"), F.nullif(F.col("_whole"), F.lit(0.0)))
    return (
        tariffs.withColumn("_whole", whole.scalar())
        .withColumn("pct_of_total", F.round(percent, 2))
        .drop("_whole")
    )


def weekday_weekend(daily: DataFrame) -> DataFrame:
    kind = F.when(F.col("weekend_flag") == 1, "weekend").otherwise("weekday")
    return daily.groupBy(kind.alias("day_group")).agg(_consumed(), _typical())


def seasonal_consumption(daily: DataFrame) -> DataFrame:
    return daily.groupBy("season").agg(_consumed(), _typical())


def weather_impact(weather: DataFrame) -> DataFrame:
    return weather.groupBy("weather_condition", "temperature_band").agg(
        mean("avg_temperature").alias("avg_temperature"),
        mean("avg_humidity").alias("avg_humidity"),
        _consumed(),
        _typical(),
    )


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    per_severity = [
        F.count_if(F.col("anomaly_severity") == level).alias(f"{level}_severity_count")
        for level in ("high", "medium", "low")
    ]
    return anomalies.groupBy(F.to_date("reading_ts").alias("date_key")).agg(
        F.count_if(F.col("anomaly_flag") == 1).alias("anomaly_count"), *per_severity
    )


def anomaly_by_meter(anomalies: DataFrame) -> DataFrame:
    return (
        anomalies.where(F.col("anomaly_flag") == 1)
        .groupBy("meter_id")
        .agg(
            rows().alias("anomaly_count"),
            mean("anomaly_score").alias("avg_anomaly_score"),
            F.max("energy_consumption").alias("max_anomalous_consumption"),
        )
    )


def prediction_accuracy(predictions: DataFrame) -> DataFrame:
    error = F.col("prediction_error")
    return (
        predictions.where(F.col("actual_consumption").isNotNull())
        .groupBy("model_name", "model_version")
        .agg(
            rows().alias("prediction_count"),
            mean(F.abs(error)).alias("mae"),
            F.sqrt(mean(error * error)).alias("rmse"),
            mean("abs_percentage_error").alias("mape"),
        )
    )


def actual_vs_predicted(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "reading_ts", "meter_id", "actual_consumption", "predicted_consumption", "prediction_error",
        "abs_percentage_error", "model_name",
    )


# View name -> warehouse table it reads and its definition.
VIEWS = {
    "vw_energy_summary": ("fact_daily_consumption", energy_summary),
    "vw_daily_trend": ("fact_daily_consumption", daily_trend),
    "vw_monthly_trend": ("fact_monthly_consumption", monthly_trend),
    "vw_hourly_pattern": ("fact_hourly_consumption", hourly_pattern),
    "vw_meter_ranking": ("fact_meter_consumption", meter_ranking),
    "vw_top_meters": ("fact_meter_consumption", top_meters),
    "vw_peak_offpeak": ("fact_peak_offpeak", peak_offpeak),
    "vw_weekday_weekend": ("fact_daily_consumption", weekday_weekend),
    "vw_seasonal_consumption": ("fact_daily_consumption", seasonal_consumption),
    "vw_weather_impact": ("fact_weather_energy", weather_impact),
    "vw_anomaly_counts": ("fact_anomalies", anomaly_counts),
    "vw_anomaly_by_meter": ("fact_anomalies", anomaly_by_meter),
    "vw_prediction_accuracy": ("fact_predictions", prediction_accuracy),
    "vw_actual_vs_predicted": ("fact_predictions", actual_vs_predicted),
}


def register_views(tables: dict[str, DataFrame]) -> list[str]:
    """Temporary views for every definition whose table is at hand."""
    made = []
    for name, (source, define) in VIEWS.items():
        if source in tables:
            define(tables[source]).createOrReplaceTempView(name)
            made.append(name)
    return made
