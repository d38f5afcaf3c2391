"""Robust z-score per meter and hour, severity, and the union of detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.aggregates import settled
from gridloom.functions.ordering import exact_median
from gridloom.functions.shared import stored
from gridloom.settings import DEFAULTS, MAD_SCALE, Settings

VALUE = "energy_consumption"
KEY = ("meter_id", "hour")
# Severity limits on the absolute rounded score.
SEVERITY_LIMITS = (("high", 6.0), ("medium", 4.0))
COLUMNS = (
    "timestamp", "meter_id", "energy_consumption", "anomaly_score", "anomaly_flag", "anomaly_type",
    "detection_method", "anomaly_severity",
)


def with_severity(scored: DataFrame) -> DataFrame:
    size = F.abs("anomaly_score")
    graded = F.when(F.col("anomaly_flag") == 0, "none")
    for label, limit in SEVERITY_LIMITS:
        graded = graded.when(size >= limit, label)
    return scored.withColumn("anomaly_severity", graded.otherwise("low"))


def zscore_anomalies(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Distance from the median of the meter's hour in units of scaled median deviation.

    A group whose deviation is zero scores zero. Readings are written once, and so are the centred ones, as medians
    read them more than once; a busy hour of one meter is narrowed down by counts before its values are ordered.
    """
    readings = stored(df.select("timestamp", *KEY, VALUE), "readings")
    centres = exact_median(readings, KEY, VALUE, "_centre")
    placed = stored(
        readings.join(centres, list(KEY), "left").withColumn("_gap", F.col(VALUE) - F.col("_centre")), "centred"
    )
    gaps = placed.select(*KEY, F.abs("_gap").alias("_distance"))
    spreads = exact_median(gaps, KEY, "_distance", "_median").withColumn("_spread", F.col("_median") * MAD_SCALE)
    scored = placed.join(spreads.drop("_median"), list(KEY), "left").withColumn(
        "_score", F.coalesce(F.try_divide("_gap", "_spread"), F.lit(0.0))
    )
    return _judged(scored, settings)


def _judged(scored: DataFrame, settings: Settings) -> DataFrame:
    score, limit = F.col("_score"), settings.zscore_threshold
    flagged: Column = F.abs(score) >= limit
    kind = (
        F.when(~flagged | (score == 0), "normal")
        .when(score >= 2 * limit, "sudden_spike")
        .when(score > 0, "high_consumption")
        .otherwise("low_consumption")
    )
    return scored.select(
        "timestamp",
        "meter_id",
        VALUE,
        settled(score, 4).alias("anomaly_score"),
        flagged.cast("int").alias("anomaly_flag"),
        kind.alias("anomaly_type"),
        F.lit("robust_zscore").alias("detection_method"),
    )


def combined(*detected: DataFrame) -> DataFrame:
    """All detectors' rows with severity."""
    together = detected[0]
    for other in detected[1:]:
        together = together.unionByName(other)
    return with_severity(together).select(*COLUMNS)


def flagged_only(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("anomaly_flag") == 1)


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Flagged rows counted by type and by severity, in one table."""
    counts = (
        flagged_only(anomalies)
        .groupBy("anomaly_type", "anomaly_severity")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_facet",
            F.explode(
                F.array(
                    F.struct(F.lit("type").alias("facet"), F.col("anomaly_type").alias("label")),
                    F.struct(F.lit("severity").alias("facet"), F.col("anomaly_severity").alias("label")),
                )
            ),
        )
    )
    return counts.groupBy("_facet.facet", "_facet.label").agg(F.sum("_n").alias("anomalies"))
