"""Star-schema tables: renames, column choice, declared types, loading, catalog registration."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TablePlan:
    """Which gold data set feeds a table, with renames and, for some, the columns to keep."""

    dataset: str
    renames: Mapping[str, str]
    columns: tuple[str, ...] = ()


_BY_DATE = {"date": "date_key"}
_BY_TIME = {"timestamp": "reading_ts"}
# Load order (dimensions first), table names and their columns.
LOAD_PLAN: Mapping[str, TablePlan] = {
    "dim_meter": TablePlan(
        "dim_meter",
        {},
        (
            "meter_id", "meter_type", "region", "installation_date", "rated_voltage",
            "base_load_kwh", "avg_consumption", "total_consumption",
        ),
    ),
    "dim_date": TablePlan(
        "dim_date",
        _BY_DATE,
        (
            "date_key", "year", "quarter", "month", "month_name", "day", "day_of_week", "day_name",
            "weekend_flag", "season",
        ),
    ),
    "fact_meter_consumption": TablePlan("meter_consumption", {}),
    "fact_hourly_consumption": TablePlan("hourly_consumption", _BY_DATE),
    "fact_daily_consumption": TablePlan("daily_consumption", _BY_DATE),
    "fact_monthly_consumption": TablePlan("monthly_consumption", {}),
    "fact_peak_offpeak": TablePlan("peak_offpeak_consumption", _BY_DATE),
    "fact_weather_energy": TablePlan("weather_energy", _BY_DATE),
    "energy_summary": TablePlan("energy_summary", {}),
}
PREDICTIONS = TablePlan(
    "predictions",
    _BY_TIME,
    (
        "reading_ts", "meter_id", "actual_consumption", "predicted_consumption",
        "prediction_error", "abs_percentage_error", "model_name", "model_version",
    ),
)
ANOMALIES = TablePlan(
    "anomalies",
    _BY_TIME,
    (
        "reading_ts", "meter_id", "energy_consumption", "anomaly_flag", "anomaly_type",
        "anomaly_score", "anomaly_severity", "detection_method",
    ),
)


def shaped(df: DataFrame, plan: TablePlan) -> DataFrame:
    renamed = df.withColumnsRenamed(dict(plan.renames))
    return renamed.select(*plan.columns) if plan.columns else renamed


def table_frame(gold: Mapping[str, DataFrame], table: str) -> DataFrame:
    return shaped(gold[LOAD_PLAN[table].dataset], LOAD_PLAN[table])


def predictions_fact(predictions: DataFrame) -> DataFrame:
    return shaped(predictions, PREDICTIONS)


def anomalies_fact(scored: DataFrame) -> DataFrame:
    """Only flagged rows are kept as facts."""
    return shaped(scored.where(F.col("anomaly_flag") == 1), ANOMALIES)


_CONSUMED = "total_consumption DECIMAL({0},4) NOT NULL, avg_consumption DECIMAL(12,4) NOT NULL"
_EXTREMES = "max_consumption DECIMAL(12,4) NOT NULL, min_consumption DECIMAL(12,4) NOT NULL"
_METER = "meter_id VARCHAR(16) NOT NULL"
_COUNT = "reading_count INT NOT NULL"
_CREATED = "created_at TIMESTAMP NOT NULL DEFAULT current_timestamp()"
# Columns of the star schema with their types.
DECLARED: Mapping[str, str] = {
    "dim_meter": f"{_METER}, meter_type VARCHAR(32) NOT NULL, region VARCHAR(32) NOT NULL, installation_date DATE, "
    "rated_voltage DECIMAL(6,2), base_load_kwh DECIMAL(10,4), avg_consumption DECIMAL(12,4), total_consumption DECIMAL(16,4)",
    "dim_date": "date_key DATE NOT NULL, year SMALLINT NOT NULL, quarter SMALLINT NOT NULL, month SMALLINT NOT NULL, "
    "month_name VARCHAR(16), day SMALLINT NOT NULL, day_of_week SMALLINT NOT NULL, day_name VARCHAR(16), "
    "weekend_flag SMALLINT NOT NULL, season VARCHAR(16) NOT NULL",
    "fact_hourly_consumption": f"date_key DATE NOT NULL, hour SMALLINT NOT NULL, {_METER}, {_CONSUMED.format(12)}, {_EXTREMES}, "
    f"{_COUNT}, avg_temperature DECIMAL(6,2), peak_hour_flag SMALLINT NOT NULL",
    "fact_daily_consumption": f"date_key DATE NOT NULL, {_METER}, {_CONSUMED.format(12)}, {_EXTREMES}, {_COUNT}, "
    "avg_temperature DECIMAL(6,2), weekend_flag SMALLINT NOT NULL, season VARCHAR(16) NOT NULL",
    "fact_monthly_consumption": f"year SMALLINT NOT NULL, month SMALLINT NOT NULL, {_METER}, {_CONSUMED.format(14)}, {_EXTREMES}, {_COUNT}",
    "fact_peak_offpeak": f"date_key DATE NOT NULL, tariff_period VARCHAR(16) NOT NULL, {_CONSUMED.format(14)}, {_COUNT}",
    "fact_weather_energy": "date_key DATE NOT NULL, weather_condition VARCHAR(32) NOT NULL, temperature_band VARCHAR(16) NOT NULL, "
    f"avg_temperature DECIMAL(6,2), avg_humidity DECIMAL(6,2), {_CONSUMED.format(14)}, {_COUNT}",
    "fact_meter_consumption": f"{_METER}, meter_type VARCHAR(32) NOT NULL, region VARCHAR(32) NOT NULL, {_CONSUMED.format(16)}, {_EXTREMES}, "
    f"stddev_consumption DECIMAL(12,4), {_COUNT}, consumption_rank INT NOT NULL",
    "fact_predictions": f"reading_ts TIMESTAMP NOT NULL, {_METER}, actual_consumption DECIMAL(12,4), "
    "predicted_consumption DECIMAL(12,4) NOT NULL, prediction_error DECIMAL(12,4), abs_percentage_error DECIMAL(12,4), "
    f"model_name VARCHAR(64) NOT NULL, model_version VARCHAR(32) NOT NULL, {_CREATED}",
    "fact_anomalies": f"reading_ts TIMESTAMP NOT NULL, {_METER}, energy_consumption DECIMAL(12,4) NOT NULL, anomaly_flag SMALLINT NOT NULL, "
    "anomaly_type VARCHAR(32) NOT NULL, anomaly_score DECIMAL(12,4), anomaly_severity VARCHAR(16) NOT NULL, "
    f"detection_method VARCHAR(32) NOT NULL, {_CREATED}",
    "energy_summary": "total_consumption DECIMAL(18,3) NOT NULL, avg_consumption DECIMAL(12,4) NOT NULL, peak_consumption DECIMAL(12,4) NOT NULL, "
    "min_consumption DECIMAL(12,4) NOT NULL, meter_count INT NOT NULL, reading_count BIGINT NOT NULL, period_start TIMESTAMP NOT NULL, "
    "period_end TIMESTAMP NOT NULL, refreshed_at TIMESTAMP NOT NULL DEFAULT current_timestamp()",
}
# What point reads look for: rows of a file lie in this order, and each meter_id has a bloom filter.
CLUSTERED: Mapping[str, tuple[str, ...]] = {
    "fact_hourly_consumption": ("meter_id", "date_key", "hour"),
    "fact_daily_consumption": ("meter_id", "date_key"),
    "fact_monthly_consumption": ("meter_id", "year", "month"),
    "fact_predictions": ("meter_id", "reading_ts"),
    "fact_anomalies": ("meter_id", "reading_ts"),
}
KEEP_SECONDS = 7 * 86400  # how long a superseded version of a table stays for readers that have begun
BLOOM = {"parquet.bloom.filter.enabled#meter_id": "true", "parquet.bloom.filter.expected.ndv#meter_id": "100000"}


@dataclass(frozen=True)
class Declared:
    name: str
    kind: str
    required: bool
    default: str | None


def declared(table: str) -> list[Declared]:
    """The columns of a table as ``DECLARED`` has them."""
    found = []
    for text in DECLARED[table].split(", "):
        name, kind, *rest = text.split(" ", 2)
        more = rest[0] if rest else ""
        default = more.partition("DEFAULT ")[2] or None
        found.append(Declared(name, kind.lower(), more.startswith("NOT NULL"), default))
    return found


def conformed(df: DataFrame, table: str) -> DataFrame:
    """The columns of ``table`` in their declared types; a missing column, a value that does not fit or a NULL is an error."""

    def typed(column: Declared) -> Column:
        kind = "string" if column.kind.startswith("varchar") else column.kind
        value = F.col(column.name).cast(kind)
        if kind == "string":
            most = int(column.kind[len("varchar(") : -1])
            value = F.when(F.length(value) > most, F.raise_error(F.lit(f"{table}.{column.name} is too long"))).otherwise(value)
        if column.required:
            value = F.coalesce(value, F.raise_error(F.lit(f"{table}.{column.name} is NULL")).cast(kind))
        return value.alias(column.name)

    absent = [c.name for c in declared(table) if c.default is None and c.name not in df.columns]
    if absent:
        raise ValueError(f"{table} lacks {', '.join(absent)}")
    return df.select(*(typed(c) for c in declared(table) if c.default is None or c.name in df.columns))


def load_table(df: DataFrame, database: str, table: str, folder: str | None = None) -> None:
    """Write a new version of a table and make it the current one when it is complete.

    Rows go to a folder of their own below ``folder`` (by default the database's location); then the table points there,
    in one change of the catalog. Readers see the old version until then, and for good if the write fails. Defaults are set
    here, as files are written by path. Versions older than ``KEEP_SECONDS`` are removed.
    """
    spark, name = df.sparkSession, f"{database}.{table}"
    root = f"{folder or spark.catalog.getDatabase(database).locationUri}/{table}"
    rows = conformed(df, table)
    given = set(rows.columns)
    rows = rows.select(*(F.col(c.name) if c.name in given else F.expr(c.default).alias(c.name) for c in declared(table)))
    version = f"{root}/v{int(time.time() * 1000):014d}-{uuid.uuid4().hex}"
    order = CLUSTERED.get(table)
    if order:
        rows = rows.hint("rebalance", *(F.col(c) for c in order[:1])).sortWithinPartitions(*order)
    rows.write.options(**(BLOOM if "meter_id" in rows.columns else {})).parquet(version)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"CREATE TABLE {name} ({DECLARED[table]}) USING parquet LOCATION '{version}'")
    _forget_versions(spark, root, version)


def _forget_versions(spark: SparkSession, root: str, current: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest = (time.time() - KEEP_SECONDS) * 1000
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v") and not current.endswith(name) and int(name[1:15]) < oldest:
            files.delete(status.getPath(), True)


def load_warehouse(
    spark: SparkSession, gold: Mapping[str, DataFrame], database: str, folder: str | None = None
) -> list[str]:
    """Load every table whose data set is present, dimensions first; returns the table names."""
    create_database(spark, database)
    loaded = []
    frames = {name: table_frame(gold, name) for name, plan in LOAD_PLAN.items() if plan.dataset in gold}
    if "predictions" in gold:
        frames["fact_predictions"] = predictions_fact(gold["predictions"])
    if "anomalies" in gold:
        frames["fact_anomalies"] = anomalies_fact(gold["anomalies"])
    for name, df in frames.items():
        load_table(df, database, name, folder)
        loaded.append(name)
    return loaded


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{at}")


def register_dataset(spark: SparkSession, name: str, path: str) -> None:
    """External parquet table over a written data set, partitions included."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    if _is_partitioned(spark, name):
        spark.catalog.recoverPartitions(name)


def _is_partitioned(spark: SparkSession, name: str) -> bool:
    return any(column.isPartition for column in spark.catalog.listColumns(name))


# Catalog names of the layers.
LAYER_TABLES = {
    "bronze_energy_readings": "bronze/energy_readings",
    "dim_meter_info": "bronze/meter_info",
    "dim_weather": "bronze/weather",
    "silver_energy_readings": "silver/energy_readings",
}
GOLD_TABLES = {
    "gold_hourly_consumption": "hourly_consumption",
    "gold_daily_consumption": "daily_consumption",
    "gold_monthly_consumption": "monthly_consumption",
    "gold_meter_consumption": "meter_consumption",
    "gold_peak_offpeak_consumption": "peak_offpeak_consumption",
    "gold_weather_energy": "weather_energy",
    "gold_predictions": "predictions",
    "gold_anomalies": "anomalies",
}


def register_layers(spark: SparkSession, database: str, base: str, gold: Mapping[str, str]) -> list[str]:
    """Catalog entries over the layer folders and over the gold paths that exist."""
    create_database(spark, database)
    paths = {name: f"{base}/{where}" for name, where in LAYER_TABLES.items()}
    paths |= {name: gold[dataset] for name, dataset in GOLD_TABLES.items() if dataset in gold}
    for name, path in paths.items():
        register_dataset(spark, f"{database}.{name}", path)
    return list(paths)
