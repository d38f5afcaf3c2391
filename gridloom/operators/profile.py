"""Profile of a data set: size, types, missing values and repeated rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.shared import stored

# Data sets a complete gold layer has.
REQUIRED_DATASETS = (
    "wide_fact", "energy_summary", "dim_date", "dim_meter", "daily_consumption",
    "weekly_consumption", "monthly_consumption", "hourly_consumption", "meter_consumption",
    "peak_offpeak_consumption", "weather_energy", "predictions", "anomalies",
)


def profile(df: DataFrame, name: str) -> DataFrame:
    """One row per column: data set, rows, repeated rows, column, type, missing values.

    ``df`` is read twice, so it should be stored. Only digests of the rows are shuffled; see ``repeated_rows``.
    """
    missing = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_null_{i}") for i, c in enumerate(df.columns)]
    sizes = df.agg(F.count(F.lit(1)).alias("row_count"), *missing)
    counts = sizes.withColumn("duplicate_rows", repeated_rows(df).scalar())
    triples = ", ".join(f"'{c}', '{t}', _null_{i}" for i, (c, t) in enumerate(df.dtypes))
    return counts.selectExpr(
        f"'{name}' AS dataset",
        "row_count",
        "duplicate_rows",
        f"stack({len(df.columns)}, {triples}) AS (column_name, data_type, null_count)",
    )


def row_digest(columns: Sequence[str]) -> Column:
    """128 bits of a row; which columns are missing is hashed too, as a hash passes over them."""
    cells = [F.col(f"`{c}`") for c in columns]
    absent = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in cells))
    return F.struct(F.xxhash64(F.lit(1), absent, *cells).alias("a"), F.xxhash64(F.lit(2), *reversed(cells), absent).alias("b"))


def repeated_rows(df: DataFrame, digest: Callable[[Sequence[str]], Column] = row_digest) -> DataFrame:
    """``duplicate_rows``: how many rows repeat an earlier one.

    Rows are counted by digest first. Only rows whose digest occurs more than once are compared whole, so a table
    without repeats moves 16 bytes a row, and digests that meet by chance cannot change the result.
    """
    keyed = df.withColumn("_digest", digest(df.columns))
    suspects = stored(keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest"), "suspects")
    if not suspects.take(1):
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("duplicate_rows"))
    copies = keyed.join(suspects, "_digest", "left_semi").groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(
        F.count(F.lit(1)).alias("_copies")
    )
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))


def missing_datasets(
    present: Mapping[str, DataFrame], required: Sequence[str] = REQUIRED_DATASETS
) -> list[str]:
    return [name for name in required if name not in present]
