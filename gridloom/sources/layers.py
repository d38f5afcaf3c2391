"""Reading and writing the bronze, silver and gold layers as parquet and CSV.

Every data set is written beside its place first and takes it only when it is complete, so a job that fails on the way leaves
readers the old version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reads of one meter skip files and row groups: a bloom filter beside the sorted columns' statistics.
SKIPPING = {"parquet.bloom.filter.enabled#meter_id": "true", "parquet.bloom.filter.expected.ndv#meter_id": "100000"}
# Data set names below each layer and the columns they are laid out by.
READINGS, METERS, WEATHER = "energy_readings", "meter_info", "weather"
GOLD_ORDER: Mapping[str, Sequence[str]] = {
    "energy_summary": (),
    "hourly_consumption": ("date", "hour", "meter_id"),
    "daily_consumption": ("date", "meter_id"),
    "weekly_consumption": ("year", "week_of_year", "meter_id"),
    "monthly_consumption": ("year", "month", "meter_id"),
    "meter_consumption": ("consumption_rank",),
    "peak_offpeak_consumption": ("date", "tariff_period"),
    "weather_energy": ("date", "weather_condition"),
    "dim_date": ("date",),
    "dim_meter": ("meter_id",),
    "ml_features": ("timestamp", "meter_id"),
    "predictions": ("timestamp", "meter_id"),
    "anomalies": ("timestamp", "meter_id", "detection_method"),
    "wide_fact": ("date", "hour", "meter_id"),
}


def published(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` make a folder, then put it where ``path`` is; the old content goes last.

    Two renames: at once on a file system, copies on an object store, where tables with a location per version
    (``warehouse.load_table``) are the better way to publish.
    """
    jvm, name = spark.sparkContext._jvm, uuid.uuid4().hex
    at = path.rstrip("/")
    folder, _, last = at.rpartition("/")
    place = {kind: jvm.org.apache.hadoop.fs.Path(f"{folder}/_{kind}-{last}-{name}") for kind in ("new", "old")}
    target = jvm.org.apache.hadoop.fs.Path(at)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(place["new"].toString())
    except BaseException:
        files.delete(place["new"], True)
        raise
    if files.exists(target) and not files.rename(target, place["old"]):
        raise OSError(f"cannot move {at} away")
    if not files.rename(place["new"], target):
        files.rename(place["old"], target)
        raise OSError(f"cannot publish {at}")
    files.delete(place["old"], True)


def write_by_day(df: DataFrame, path: str, day: str) -> None:
    """One directory per day, in files of a sensible size.

    Rebalancing gathers the rows of a day so that a directory gets few files, and splits a day
    that holds most of the rows over several tasks.
    """
    balanced = df.hint("rebalance", F.col(day))
    laid_out = balanced.sortWithinPartitions(day, "meter_id").write.partitionBy(day).options(**SKIPPING)
    published(df.sparkSession, path, laid_out.parquet)


def write_dataset(df: DataFrame, path: str) -> None:
    published(df.sparkSession, path, df.write.parquet)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def gold_path(folder: str, name: str, kind: str = "parquet") -> str:
    return f"{folder}/{name}.{kind}"


def write_gold(df: DataFrame, folder: str, name: str) -> DataFrame:
    """One gold data set as parquet and CSV; the CSV is copied from the parquet, not computed twice.

    Rows are sorted inside each file for selective reads; a global order is left to readers.
    """
    order = GOLD_ORDER.get(name, ())
    laid_out = df.sortWithinPartitions(*order) if order else df
    spark, skipping = df.sparkSession, SKIPPING if "meter_id" in df.columns else {}
    published(spark, gold_path(folder, name), laid_out.write.options(**skipping).parquet)
    saved = spark.read.schema(df.schema).parquet(gold_path(folder, name))
    published(spark, gold_path(folder, name, "csv"), lambda path: saved.write.csv(path, header=True))
    return saved


def write_report(df: DataFrame, path: str) -> None:
    """Small report rows as JSON lines."""
    published(df.sparkSession, path, df.write.json)
