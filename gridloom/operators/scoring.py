"""Predictions, their error columns, accuracy metrics and batch requests."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.functions.aggregates import mean, rows, settled
from gridloom.operators import features
from gridloom.operators.split import find_boundary
from gridloom.settings import DEFAULTS, TIMESTAMP_FORMAT, Settings

PREDICTION = "prediction"
# Request fields that must be there, and those that must be numbers where given.
REQUIRED_FIELDS = ("timestamp", "meter_id", "temperature", "humidity")
NUMBER_FIELDS = ("temperature", "humidity", "voltage", "current", "power_factor")


class Forecast(Protocol):
    """Anything with a name that adds a ``prediction`` column to feature rows."""

    name: str

    def transform(self, rows: DataFrame) -> DataFrame: ...


class Persistence:
    """Yesterday's value at this position: the forecast every model has to beat."""

    name = "Persistence"

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PREDICTION, F.col("lag_24h"))


def _tags(forecast: Forecast, settings: Settings) -> list[Column]:
    return [F.lit(forecast.name).alias("model_name"), F.lit(settings.model_version).alias("model_version")]


def with_errors(scored: DataFrame, forecast: Forecast, settings: Settings = DEFAULTS) -> DataFrame:
    """Prediction table: actual, predicted, error and absolute percentage error (0 where undefined)."""
    values = scored.select(
        "timestamp",
        "meter_id",
        F.round(features.TARGET, 4).alias("actual_consumption"),
        F.round(PREDICTION, 4).alias("predicted_consumption"),
    ).withColumn(
        "prediction_error", F.round(F.col("predicted_consumption") - F.col("actual_consumption"), 4)
    )
    relative = F.try_divide(100.0 * F.abs("prediction_error"), F.col("actual_consumption"))
    return values.withColumn(
        "abs_percentage_error", F.coalesce(settled(relative, 4), F.lit(0.0))
    ).select("*", *_tags(forecast, settings))


def holdout_predictions(
    feature_rows: DataFrame, forecast: Forecast, settings: Settings = DEFAULTS
) -> DataFrame:
    """Score the chronologically last share of the feature rows."""
    complete = features.model_rows(feature_rows, settings)
    training = find_boundary(complete, settings.test_size).in_training()
    return with_errors(forecast.transform(complete.where(~training)), forecast, settings)


def predicted_frame(
    feature_rows: DataFrame, forecast: Forecast, settings: Settings = DEFAULTS
) -> DataFrame:
    """Batch scoring without known targets."""
    scored = forecast.transform(features.model_rows(feature_rows, settings))
    return scored.select(
        "timestamp",
        "meter_id",
        F.round(PREDICTION, 4).alias("predicted_consumption"),
        *_tags(forecast, settings),
    )


def prediction_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        rows().alias("rows"),
        F.round(mean(F.abs("prediction_error")), 5).alias("mae"),
        F.round(mean("abs_percentage_error"), 5).alias("mape"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, MSE, RMSE and R² to five digits, in one pass.

    The spread of the target comes from its population variance, which merges stably.
    """
    gap = F.col(predicted) - F.col(actual)
    sums = df.agg(
        mean(F.abs(gap)).alias("mae"), mean(gap * gap).alias("mse"), F.var_pop(actual).alias("_spread")
    )
    return sums.select(
        F.round("mae", 5).alias("mae"),
        F.round("mse", 5).alias("mse"),
        F.round(F.sqrt("mse"), 5).alias("rmse"),
        F.round(1 - F.try_divide("mse", "_spread"), 5).alias("r2"),
    )


def check_requests(requests: DataFrame, known_meters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests into usable ones and rejected ones with a ``reason``.

    ``requests`` may carry any feature column to override the meter's last known value.
    """
    given = [c for c in NUMBER_FIELDS if c in requests.columns]
    numbers = {c: F.expr(f"nullif(try_cast(`{c}` AS DOUBLE), double('NaN'))") for c in given}
    wrong = F.concat_ws(",", *[F.when(F.col(c).isNotNull() & numbers[c].isNull(), F.lit(c)) for c in given])
    typed = requests.withColumn("_at", F.try_to_timestamp("timestamp", F.lit(TIMESTAMP_FORMAT)))
    missing = [F.when(F.col(name).isNull(), F.lit(name)) for name in REQUIRED_FIELDS]
    listed = F.concat_ws(",", *missing)
    reason = F.when(listed != "", F.concat(F.lit("missing: "), listed)).when(
        F.col("_at").isNull(), "timestamp not readable"
    ).when(wrong != "", F.concat(F.lit("not a number: "), wrong))
    typed = typed.withColumn("reason", reason).withColumns(numbers)
    sound = typed.where(F.col("reason").isNull()).drop("reason")
    ids = known_meters.select("meter_id").distinct()
    unknown = sound.join(ids, "meter_id", "left_anti").withColumn("reason", F.lit("unknown meter"))
    rejected = typed.where(F.col("reason").isNotNull()).unionByName(unknown)
    accepted = sound.join(ids, "meter_id", "left_semi")
    return (
        accepted.withColumn("timestamp", F.col("_at")).drop("_at"),
        rejected.select("timestamp", "meter_id", "reason"),
    )


def predict_requests(
    requests: DataFrame,
    history: DataFrame,
    forecast: Forecast,
    settings: Settings = DEFAULTS,
    *,
    recompute: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Score a table of requests; returns predictions and rejected requests.

    Each request starts from the last known row of its meter and overrides every column it
    carries; calendar columns and season follow the requested time. Lags are the ones of the last
    row; with ``recompute`` they are taken from the meter's latest readings instead, as if the
    requested reading came next.
    """
    base = [c for c in history.columns if c not in ("timestamp", "meter_id")]
    accepted, rejected = check_requests(requests, history)
    asked_for = history.join(accepted.select("meter_id").distinct(), "meter_id", "left_semi")
    latest = asked_for.groupBy("meter_id").agg(
        F.max_by(F.struct(*base), F.col("timestamp")).alias("_last")
    )
    if recompute:
        latest = latest.join(_next_history(asked_for, settings), "meter_id")
        following = {name: F.col(f"_next.{name}") for name in features.history_names(settings)}
    else:
        following = {}
    at = F.col("timestamp")
    calendar_values = {
        "hour": F.hour(at),
        "day": F.dayofmonth(at),
        "month": F.month(at),
        "year": F.year(at),
        "day_of_week": F.dayofweek(at),
        "weekend_flag": calendar.weekend_flag(at),
        "peak_hour_flag": calendar.peak_hour_flag(at),
        "season": calendar.season(F.month(at)),
        "date": F.to_date(at),
    }

    def value(column: str) -> Column:
        if column in calendar_values:
            return calendar_values[column]
        known = following.get(column, F.col(f"_last.{column}"))
        return F.coalesce(F.col(f"_asked.{column}"), known) if column in accepted.columns else known

    asked = accepted.select("timestamp", "meter_id", F.struct(*accepted.columns).alias("_asked"))
    filled = asked.join(latest, "meter_id").select(
        "timestamp", "meter_id", *[value(c).alias(c) for c in base]
    )
    gaps = F.lit(False)
    for name in features.history_names(settings):
        gaps = gaps | F.col(name).isNull()
    short = filled.where(gaps).select(
        F.date_format("timestamp", TIMESTAMP_FORMAT).alias("timestamp"),
        "meter_id",
        F.lit("history too short").alias("reason"),
    )
    return predicted_frame(filled.where(~gaps), forecast, settings), rejected.unionByName(short)


def _next_history(history: DataFrame, settings: Settings) -> DataFrame:
    """History columns as a reading after each meter's last one would have them."""
    last = history.groupBy("meter_id").agg(F.max("timestamp").alias("timestamp"))
    after = last.select("meter_id", (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("timestamp"))
    known = history.select("meter_id", "timestamp", features.TARGET, F.lit(False).alias("_new"))
    extended = known.unionByName(
        after.select("*", F.lit(None).cast("double").alias(features.TARGET), F.lit(True).alias("_new"))
    )
    names = features.history_names(settings)
    fresh = features.with_history(extended, settings).where("_new")
    return fresh.select("meter_id", F.struct(*names).alias("_next"))
