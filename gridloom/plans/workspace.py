"""All layers of one source folder as DataFrames, built on demand."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.operators import anomaly, features, gold, scoring, silver, widefact
from gridloom.plans.session import settle
from gridloom.settings import DEFAULTS, Settings
from gridloom.sources import bundled, feeds, warehouse


class Workspace:
    """Plans over the driver tables in ``folder``.

    ``silver`` and what follows from it stay lazy. ``shared`` gives the same layers over a silver
    table written once, for queries that read silver several times.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> None:
        self.spark, self.folder, self.settings = settle(spark), folder, settings

    def table(self, name: str) -> DataFrame:
        return bundled.table(self.spark, self.folder, name)

    @cached_property
    def readings(self) -> DataFrame:
        return bundled.readings(self.table("events"))

    @cached_property
    def meters(self) -> DataFrame:
        return bundled.meters(self.table("customer"))

    @cached_property
    def weather(self) -> DataFrame:
        return bundled.weather(self.table("events"))

    @cached_property
    def bronze(self) -> DataFrame:
        return feeds.to_bronze(self.readings, F.col("arrived_at")).drop("arrived_at")

    @cached_property
    def silver(self) -> DataFrame:
        return silver.to_silver(self.bronze, self.settings)

    @cached_property
    def shared(self) -> Workspace:
        other = Workspace(self.spark, self.folder, self.settings)
        other.silver = stored(self.silver, "silver")
        return other

    @cached_property
    def features(self) -> DataFrame:
        return features.ml_features(self.silver, self.settings)

    @cached_property
    def feature_table(self) -> DataFrame:
        return stored(self.features, "features")

    @cached_property
    def predictions(self) -> DataFrame:
        """Hold-out predictions of the persistence forecast."""
        rows = features.model_rows(self.feature_table, self.settings)
        return scoring.holdout_predictions(rows, scoring.Persistence(), self.settings)

    @cached_property
    def anomalies(self) -> DataFrame:
        """Flagged rows of the robust z-score."""
        scored = anomaly.zscore_anomalies(self.silver, self.settings)
        return anomaly.flagged_only(anomaly.combined(scored))

    def gold(self, name: str) -> DataFrame:
        if name == "dim_meter":
            return gold.dim_meter(self.silver, self.meters)
        if name == "ml_features":
            return self.features
        if name in ("predictions", "anomalies", "wide_fact"):
            return getattr(self, name)
        return getattr(gold, name)(self.silver)

    @cached_property
    def wide_fact(self) -> DataFrame:
        return widefact.wide_fact(
            gold.hourly_consumption(self.silver), self.silver, self.predictions, self.anomalies
        )

    def warehouse(self, table: str) -> DataFrame:
        if table == "fact_predictions":
            return warehouse.predictions_fact(self.predictions)
        if table == "fact_anomalies":
            return warehouse.anomalies_fact(self.anomalies)
        plan = warehouse.LOAD_PLAN[table]
        return warehouse.shaped(self.gold(plan.dataset), plan)
