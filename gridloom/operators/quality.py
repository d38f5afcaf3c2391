"""Data-quality report of one layer: two passes, one for row checks and one for duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.settings import DEFAULTS, Settings

# Check names, in report order, and the ones that only warn.
CHECKS = (
    "null_timestamp",
    "null_meter_id",
    "null_energy_consumption",
    "duplicate_rows",
    "invalid_timestamp",
    "invalid_meter_id",
    "invalid_energy",
    "invalid_voltage",
    "invalid_current",
    "invalid_power_factor",
)
WARNING_ONLY = ("invalid_voltage", "invalid_current", "invalid_power_factor")


class QualityError(ValueError):
    """A strict run met a failing check."""


def _row_checks(settings: Settings) -> dict[str, Column]:
    def outside(column: str) -> Column:
        low, high = settings.bounds[column]
        return ~F.col(column).between(low, high)

    return {
        "null_timestamp": F.col("timestamp").isNull(),
        "null_meter_id": F.col("meter_id").isNull(),
        "null_energy_consumption": F.col("energy_consumption").isNull(),
        "invalid_timestamp": F.col("timestamp").isNull(),
        "invalid_meter_id": ~F.col("meter_id").rlike(settings.meter_id_pattern),
        "invalid_energy": outside("energy_consumption"),
        "invalid_voltage": outside("voltage"),
        "invalid_current": outside("current"),
        "invalid_power_factor": outside("power_factor"),
    }


def quality_report(df: DataFrame, layer: str, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: layer, total_rows, every check, the failing checks as text, and ``passed``.

    NULL values are neither inside nor outside of a bound. ``duplicate_rows`` counts keys that
    occur more than once, with missing timestamps or ids forming keys of their own. Only that
    count moves data, and only the two key columns, counted per task first.
    """
    repeated = (
        df.groupBy("timestamp", "meter_id")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .agg(F.count_if(F.col("_rows") > 1).alias("duplicate_rows"))
    )
    checks = [F.count_if(test).alias(name) for name, test in _row_checks(settings).items()]
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), *checks).withColumn(
        "duplicate_rows", repeated.scalar()
    )
    failing = [
        F.when(F.col(name) > 0, F.concat(F.lit(f"{name}="), F.col(name).cast("string")))
        for name in CHECKS
        if name not in WARNING_ONLY
    ]
    return counts.select(
        F.lit(layer).alias("layer"), "total_rows", *CHECKS, F.concat_ws(",", *failing).alias("failures")
    ).withColumn("passed", F.col("failures") == "")


def as_rows(report: DataFrame) -> DataFrame:
    """The report as one row per check."""
    pairs = ", ".join(f"'{name}', {name}" for name in CHECKS)
    return report.selectExpr(
        "layer", "total_rows", f"stack({len(CHECKS)}, {pairs}) AS (check_name, violations)", "passed"
    )


def require_quality(report: DataFrame) -> dict:
    """Read the one-row report and raise if a check failed."""
    found = report.first().asDict()
    if not found["passed"]:
        raise QualityError(f"layer {found['layer']}: {found['failures']}")
    return found
