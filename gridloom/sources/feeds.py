"""Raw CSV feeds and their typed bronze form."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.settings import SOURCE_SYSTEM, TIMESTAMP_FORMAT
from gridloom.sources import schemas


class Feeds(NamedTuple):
    readings: DataFrame
    meters: DataFrame
    weather: DataFrame


def read_feeds(spark: SparkSession, folder: str) -> Feeds:
    """Headered CSV in permissive mode: a value that does not parse becomes NULL."""

    def feed(name: str, schema) -> DataFrame:
        return spark.read.csv(f"{folder}/{schemas.FEED_FILES[name]}", schema=schema, header=True)

    return Feeds(
        feed("readings", schemas.READINGS), feed("meters", schemas.METERS), feed("weather", schemas.WEATHER)
    )


def write_feeds(feeds: Feeds, folder: str) -> None:
    """The same feeds as headered CSV, keeping blanks around values as they are."""
    for name, df in feeds._asdict().items():
        _write_csv(df, f"{folder}/{schemas.FEED_FILES[name]}", "overwrite")


def deliver(readings: DataFrame, folder: str) -> None:
    """One more delivery of readings beside those already there, as files of their own that are later than theirs."""
    _write_csv(readings, f"{folder}/{schemas.FEED_FILES['readings']}", "append")


def _write_csv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def file_arrival() -> Column:
    """When the file that a row comes from was written: the arrival time of rows read straight from files."""
    return F.col("_metadata.file_modification_time")


def parsed(column: str) -> Column:
    """NULL for text that is not a timestamp, also under ANSI rules."""
    return F.try_to_timestamp(F.col(column), F.lit(TIMESTAMP_FORMAT))


def to_bronze(readings: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Typed readings stamped with arrival time, source and event date.

    ``arrival`` is the time a row came in (``file_arrival()`` for a feed of files, so that a later file corrects an
    earlier one); without it the time of the run is used.
    """
    # First, because columns about files are known only next to the scan.
    arrived = readings.withColumn("ingestion_ts", F.current_timestamp() if arrival is None else arrival)
    typed = arrived.withColumn("timestamp", parsed("timestamp"))
    return typed.withColumns(
        {
            "source_system": F.lit(SOURCE_SYSTEM),
            "event_date": F.to_date("timestamp"),
        }
    )


def weather_to_bronze(weather: DataFrame) -> DataFrame:
    return weather.withColumn("timestamp", parsed("timestamp"))
