"""One flat fact row per date, hour and meter: consumption, context, prediction and anomaly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["date", "hour", "meter_id"]
CONTEXT = (
    "temperature", "humidity", "weather_condition", "temperature_band", "season", "weekend_flag",
    "day_of_week",
)
PREDICTED = ("predicted_consumption", "prediction_error", "abs_percentage_error", "model_name")


def _first_of_hour(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per key, the earliest; leaves rows partitioned as the join needs them."""
    chosen = F.min_by(F.struct(*columns), F.struct("timestamp", *columns))
    return (
        df.groupBy(F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour"), "meter_id")
        .agg(chosen.alias("_first"))
        .select(*KEY, *[F.col(f"_first.{c}").alias(c) for c in columns])
    )


def _strongest(anomalies: DataFrame) -> DataFrame:
    """Any flag counts; type, score and severity are those of the largest absolute score."""
    carried = ["anomaly_type", "anomaly_score", "anomaly_severity"]
    order = F.struct(F.abs("anomaly_score"), *carried)
    return (
        anomalies.groupBy(F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour"), "meter_id")
        .agg(
            F.max("anomaly_flag").alias("anomaly_flag"),
            F.max_by(F.struct(*carried), order).alias("_top"),
        )
        .select(*KEY, "anomaly_flag", *[F.col(f"_top.{c}").alias(c) for c in carried])
    )


def wide_fact(
    hourly: DataFrame,
    features: DataFrame,
    predictions: DataFrame | None = None,
    anomalies: DataFrame | None = None,
) -> DataFrame:
    """Left-join everything known about an hour of a meter.

    Every side is unique on the key before the join, so no row multiplies and none needs to be
    dropped afterwards; all sides share one hash partitioning. Without predictions their columns
    are absent; without anomalies every row is normal.
    """
    fact = hourly.join(_first_of_hour(features, CONTEXT), KEY, "left")
    if predictions is not None:
        fact = fact.join(_first_of_hour(predictions, PREDICTED), KEY, "left")
    if anomalies is not None:
        fact = fact.join(_strongest(anomalies), KEY, "left")
    else:
        nothing = {"anomaly_flag": "int", "anomaly_type": "string", "anomaly_severity": "string"}
        fact = fact.withColumns({name: F.lit(None).cast(kind) for name, kind in nothing.items()})
    return fact.withColumns(
        {
            "anomaly_flag": F.coalesce("anomaly_flag", F.lit(0)),
            "anomaly_type": F.coalesce("anomaly_type", F.lit("normal")),
            "anomaly_severity": F.coalesce("anomaly_severity", F.lit("none")),
            "date": F.col("date").cast("timestamp"),
        }
    )


def wide_fact_summary(fact: DataFrame) -> DataFrame:
    predicted = F.count("predicted_consumption") if "predicted_consumption" in fact.columns else F.lit(0)
    return fact.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("anomaly_flag").alias("anomaly_rows"),
        predicted.alias("predicted_rows"),
    )


# Labels and limits of the calculated columns.
CONSUMPTION_BANDS = ((2, "Low"), (6, "Medium"), (12, "High"))
TOP_BAND = "Very High"
SEVERITY_LABELS = {"high": "High severity", "medium": "Medium severity", "low": "Low severity"}


def _hour_label() -> Column:
    return F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00"))


def _anomaly_label() -> Column:
    severity = F.col("anomaly_severity")
    label = F.lit("Normal")
    for value, text in SEVERITY_LABELS.items():
        label = F.when(severity == value, text).otherwise(label)
    return label


def _band() -> Column:
    consumed = F.col("total_consumption")
    (limit, label), *others = CONSUMPTION_BANDS
    band = F.when(consumed < limit, label)
    for limit, label in others:
        band = band.when(consumed < limit, label)
    return band.otherwise(TOP_BAND)


def labelled_fact(fact: DataFrame) -> DataFrame:
    return fact.withColumns(
        {
            "tariff_label": F.when(F.col("peak_hour_flag") == 1, "Peak").otherwise("Off-Peak"),
            "hour_label": _hour_label(),
            "consumption_band": _band(),
            "anomaly_label": _anomaly_label(),
        }
    )


def labelled_dates(dim_date: DataFrame) -> DataFrame:
    return dim_date.withColumns(
        {
            "month_year": F.date_format("date", "MMM yyyy"),
            "is_weekend": F.when(F.col("weekend_flag") == 1, "Weekend").otherwise("Weekday"),
        }
    )


def labelled_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("absolute_error", F.abs("prediction_error"))
