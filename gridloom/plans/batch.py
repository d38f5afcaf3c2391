"""The whole batch: feeds to bronze, silver, gold, warehouse, forecasts, anomalies and wide fact.

Every stage reads the tables the stage before has written and replaces its own, so a batch can be
repeated and a lost executor costs only the tasks it ran. All locations are plain URIs.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import temporary_storage
from gridloom.operators import anomaly, features, gold, iforest, models, profile, quality, scoring, silver, widefact
from gridloom.plans.session import session
from gridloom.settings import DEFAULTS, Settings
from gridloom.sources import feeds, layers, warehouse


@dataclass(frozen=True)
class Locations:
    base: str

    @property
    def raw(self) -> str:
        return f"{self.base}/raw"

    def layer(self, layer: str, name: str) -> str:
        return f"{self.base}/{layer}/{name}"

    @property
    def gold(self) -> str:
        return f"{self.base}/gold"

    @property
    def models(self) -> str:
        return f"{self.base}/models"

    def report(self, name: str) -> str:
        return f"{self.base}/reports/{name}"


def _checked(df: DataFrame, layer: str, at: Locations, strict: bool, settings: Settings) -> dict:
    report = quality.quality_report(df, layer, settings)
    layers.write_report(report, at.report(f"{layer}_quality"))
    saved = df.sparkSession.read.schema(report.schema).json(at.report(f"{layer}_quality"))
    return quality.require_quality(saved) if strict else saved.first().asDict()


def bronze_stage(spark: SparkSession, at: Locations, strict: bool, settings: Settings) -> dict:
    raw = feeds.read_feeds(spark, at.raw)
    bronze = feeds.to_bronze(raw.readings, feeds.file_arrival())
    target = at.layer("bronze", layers.READINGS)
    if strict:  # nothing is published when the feed fails
        report = _checked(bronze, "bronze", at, True, settings)
        layers.write_by_day(bronze, target, "event_date")
    else:
        layers.write_by_day(bronze, target, "event_date")
        report = _checked(layers.read(spark, target), "bronze", at, False, settings)
    layers.write_dataset(raw.meters, at.layer("bronze", layers.METERS))
    layers.write_dataset(feeds.weather_to_bronze(raw.weather), at.layer("bronze", layers.WEATHER))
    return report


def silver_stage(spark: SparkSession, at: Locations, strict: bool, settings: Settings) -> dict:
    bronze = layers.read(spark, at.layer("bronze", layers.READINGS))
    target = at.layer("silver", layers.READINGS)
    layers.write_by_day(silver.to_silver(bronze, settings), target, "date")
    return _checked(layers.read(spark, target), "silver", at, strict, settings)


def gold_stage(spark: SparkSession, at: Locations, settings: Settings) -> dict[str, DataFrame]:
    readings = layers.read(spark, at.layer("silver", layers.READINGS))
    meters = layers.read(spark, at.layer("bronze", layers.METERS))
    made = {name: make(readings) for name, make in gold.DATASETS.items()}
    made["dim_meter"] = gold.dim_meter(readings, meters)
    made["ml_features"] = features.ml_features(readings, settings)
    return {name: layers.write_gold(df, at.gold, name) for name, df in made.items()}


def forecast_stage(
    spark: SparkSession,
    at: Locations,
    feature_table: DataFrame,
    sizes: models.ModelSizes,
    train: bool,
    settings: Settings,
    sample_rows: int | None = None,
) -> DataFrame:
    if train:
        training = models.train(feature_table, settings, sizes, sample_rows=sample_rows)
        models.save(training, at.models)
        scored = training.best.transform(training.test_rows)
        made = scoring.with_errors(scored, training.best, settings)
    else:
        made = scoring.holdout_predictions(feature_table, models.load_best(spark, at.models), settings)
    return layers.write_gold(made, at.gold, "predictions")


def anomaly_stage(at: Locations, feature_table: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """The flagged rows as written, and how many rows were scored for them."""
    seen = Observation()
    detected = anomaly.combined(
        anomaly.zscore_anomalies(feature_table, settings),
        iforest.isolation_forest_anomalies(feature_table, settings),
    )
    counted = detected.observe(seen, F.count(F.lit(1)).alias("scored"))
    return layers.write_gold(anomaly.flagged_only(counted), at.gold, "anomalies"), seen.get["scored"]


def run_batch(
    spark: SparkSession,
    base: str,
    *,
    strict: bool = False,
    train: bool = True,
    database: str | None = None,
    sizes: models.ModelSizes = models.ModelSizes(),
    settings: Settings = DEFAULTS,
    sample_rows: int | None = None,
    evaluate: bool = False,
) -> dict:
    """Run every stage below ``base``; with ``database`` also load and register the tables.

    ``sample_rows`` trains on the newest rows only; ``evaluate`` measures the saved model again. What stages
    keep for themselves is deleted at the end, however the batch ends.
    """
    with temporary_storage(spark):
        return _run(spark, base, strict, train, database, sizes, settings, sample_rows, evaluate)


def _run(
    spark: SparkSession, base: str, strict: bool, train: bool, database: str | None, sizes: models.ModelSizes,
    settings: Settings, sample_rows: int | None, evaluate: bool,
) -> dict:
    started, at = time.monotonic(), Locations(base.rstrip("/"))
    summary: dict = {"bronze": bronze_stage(spark, at, strict, settings)}
    summary["silver"] = silver_stage(spark, at, strict, settings)
    data = gold_stage(spark, at, settings)
    data["predictions"] = forecast_stage(spark, at, data["ml_features"], sizes, train, settings, sample_rows)
    summary["predictions"] = scoring.prediction_summary(data["predictions"]).first().asDict()
    if evaluate:
        summary["saved_model"] = models.evaluate_saved(spark, at.models, data["ml_features"], settings).first().asDict()
    data["anomalies"], scored = anomaly_stage(at, data["ml_features"], settings)
    found = anomaly.anomaly_summary(data["anomalies"]).collect()  # one row a type or severity
    summary["anomalies"] = {"scored_rows": scored} | {f"{r['facet']}:{r['label']}": r["anomalies"] for r in found}
    fact = widefact.wide_fact(
        data["hourly_consumption"], data["ml_features"], data["predictions"], data["anomalies"]
    )
    data["wide_fact"] = layers.write_gold(fact, at.gold, "wide_fact")
    summary["gold"] = _row_counts(spark, data, at)
    summary["profile_missing"] = _profiles(data, at)
    if database is not None:
        summary["warehouse"] = warehouse.load_warehouse(spark, data, database, f"{at.base}/warehouse")
        paths = {name: layers.gold_path(at.gold, name) for name in data}
        summary["catalog"] = warehouse.register_layers(spark, database, at.base, paths)
    return summary | {"duration_seconds": float(f"{time.monotonic() - started:.3f}")}


def _row_counts(spark: SparkSession, data: Mapping[str, DataFrame], at: Locations) -> dict[str, int]:
    """Counts come from parquet footers; one number per data set reaches the driver."""
    counts = {name: df.count() for name, df in data.items()}
    report = spark.createDataFrame(list(counts.items()), "dataset string, row_count long")
    layers.write_report(report.coalesce(1), at.report("gold_row_counts"))
    return counts


def _profiles(data: Mapping[str, DataFrame], at: Locations) -> list[str]:
    for name in profile.REQUIRED_DATASETS:
        if name in data:
            layers.write_report(profile.profile(data[name], name), at.report(f"profile/{name}"))
    return profile.missing_datasets(data)


def main() -> None:
    parser = argparse.ArgumentParser(description="Run the metering batch below a base folder")
    parser.add_argument("base", help="folder URI holding raw/ and receiving every other layer")
    parser.add_argument("--strict", action="store_true", help="stop when a quality check fails")
    parser.add_argument("--skip-train", action="store_true", help="use the saved model")
    parser.add_argument("--sample-rows", type=int, help="train on this many of the newest rows")
    parser.add_argument("--evaluate", action="store_true", help="measure the saved model on the hold-out rows")
    parser.add_argument("--database", help="also load the star schema and register tables here")
    given = parser.parse_args()
    done = run_batch(
        session(), given.base, strict=given.strict, train=not given.skip_train, database=given.database,
        sample_rows=given.sample_rows, evaluate=given.evaluate,
    )
    print(json.dumps(done, indent=2, default=str))


if __name__ == "__main__":
    main()
