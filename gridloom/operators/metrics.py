"""Named measures over the wide fact, sliceable by any column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.aggregates import mean, rows, share, total

_CONSUMED = "total_consumption"


def _when(condition: Column) -> Column:
    """Consumption under a condition; NULL where no row meets it."""
    return total(F.when(condition, F.col(_CONSUMED)))


def fact_measures() -> dict[str, Column]:
    flagged = F.col("anomaly_flag") == 1
    predicted = total("predicted_consumption")
    return {
        "total_energy_consumption": total(_CONSUMED),
        "average_consumption": mean("avg_consumption"),
        "peak_consumption": F.max("max_consumption"),
        "minimum_consumption": F.min("min_consumption"),
        "meter_count": F.count_distinct("meter_id"),
        "total_readings": F.sum("reading_count"),
        "total_anomalies": F.count_if(flagged),
        "anomaly_rate_pct": share(F.count_if(flagged), rows()),
        "high_severity_anomalies": F.count_if(flagged & (F.col("anomaly_severity") == "high")),
        "peak_consumption_share_pct": share(_when(F.col("peak_hour_flag") == 1), total(_CONSUMED)),
        "weekend_consumption": _when(F.col("weekend_flag") == 1),
        "weekday_consumption": _when(F.col("weekend_flag") == 0),
        "predicted_consumption": predicted,
        "actual_vs_predicted_delta": F.round(total(_CONSUMED) - F.coalesce(predicted, F.lit(0.0)), 4),
        "average_temperature": mean("temperature"),
        "average_humidity": mean("humidity"),
    }


def prediction_measures() -> dict[str, Column]:
    error = F.col("prediction_error")
    return {
        "prediction_mae": mean(F.abs(error)),
        "prediction_rmse": F.sqrt(mean(error * error)),
        "prediction_mape_pct": mean("abs_percentage_error"),
    }


def sliced(
    fact: DataFrame,
    *,
    dates: tuple | None = None,
    meters: Sequence[str] | None = None,
    meter_types: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
) -> DataFrame:
    """Slicers: an inclusive date range and lists of allowed values."""
    if dates is not None:
        fact = fact.where(F.col("date").between(*dates))
    for column, allowed in (
        ("meter_id", meters),
        ("meter_type", meter_types),
        ("anomaly_severity", severities),
    ):
        if allowed is not None:
            fact = fact.where(F.col(column).isin(*allowed))
    return fact


def measure(
    df: DataFrame,
    names: Sequence[str] | None = None,
    by: Sequence[str | Column] = (),
    measures: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One aggregation computing the named measures per combination of ``by``."""
    known = fact_measures() if measures is None else measures
    chosen = [known[name].alias(name) for name in (known if names is None else names)]
    return df.groupBy(*by).agg(*chosen)


def month_over_month(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Change against the previous calendar month in percent, 0 where that month is missing."""
    by = list(by)
    months = fact.groupBy(*by, F.trunc("date", "month").alias("month_start")).agg(
        total(_CONSUMED).alias("total_energy_consumption")
    )
    before = months.select(
        *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)],
        F.add_months("month_start", 1).alias("_next"),
        F.col("total_energy_consumption").alias("previous_month"),
    )
    same = F.col("month_start") == F.col("_next")
    for i, column in enumerate(by):
        same = same & F.col(column).eqNullSafe(F.col(f"_b{i}"))
    change = F.col("total_energy_consumption") - F.col("previous_month")
    return (
        months.join(before, same, "left")
        .withColumn("consumption_mom_pct", share(change, F.col("previous_month")))
        .select(*by, "month_start", "total_energy_consumption", "previous_month", "consumption_mom_pct")
    )


def rolling_days(fact: DataFrame, days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Consumption per day and over the ``days`` calendar days ending there.

    Days are aggregated first; each slice then holds at most one row per calendar day.
    """
    by = list(by)
    day = F.to_date("date")
    per_day = fact.groupBy(*by, day.alias("day")).agg(total(_CONSUMED).alias("total_energy_consumption"))
    ending_here = Window.partitionBy(*by).orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    return per_day.withColumn(
        f"rolling_{days}d_consumption", F.round(F.sum("total_energy_consumption").over(ending_here), 4)
    )
