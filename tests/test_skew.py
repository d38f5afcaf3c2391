"""One key with most of the rows, checked against plain Python."""

import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from gridloom.operators import gold, silver

HOUR = dt.datetime(2023, 7, 1, 8)


def bronze(spark, copies):
    """One reading sent ``copies`` times with rising values, one busy meter, some quiet ones."""
    number = F.col("id")
    hot = spark.range(copies).select(F.lit("MTR-001").alias("meter_id"), F.lit(HOUR).alias("timestamp"), number)
    busy = spark.range(2000).select(
        F.lit("MTR-002").alias("meter_id"), (F.lit(HOUR) + F.make_dt_interval(hours=number.cast("int"))).alias("timestamp"), number
    )
    quiet = spark.range(50).select(
        F.concat(F.lit("MTR-1"), F.lpad(number.cast("string"), 2, "0")).alias("meter_id"), F.lit(HOUR).alias("timestamp"), number
    )
    return hot.union(busy).union(quiet).select(
        "meter_id",
        "timestamp",
        F.lit("residential").alias("meter_type"),
        F.lit("North").alias("region"),
        F.when(number % 7 != 3, (number % 90).cast("double")).alias("energy_consumption"),
        (170 + number % 120).cast("double").alias("voltage"),
        F.lit(5.0).alias("current"),
        F.lit(0.9).alias("power_factor"),
        F.lit(20.0).alias("temperature"),
        F.lit(50.0).alias("humidity"),
        F.lit("rain").alias("weather_condition"),
        (F.lit(HOUR) + F.make_dt_interval(secs=number)).alias("ingestion_ts"),
    )


def test_silver_and_gold_with_a_hot_key(spark):
    df = bronze(spark, 20_000)
    latest = {}
    for r in df.select("meter_id", "timestamp", "ingestion_ts", "energy_consumption").collect():
        key = (r["meter_id"], r["timestamp"])
        if key not in latest or r["ingestion_ts"] > latest[key][0]:
            latest[key] = (r["ingestion_ts"], r["energy_consumption"])
    per_meter = defaultdict(list)
    for (meter, _), (_, value) in latest.items():
        per_meter[meter].append(value)
    expected = {}
    for meter, values in per_meter.items():
        known = [v for v in values if v is not None]
        if known:
            mean = sum(known) / len(known)
            expected[meter] = (len(values), round(sum(mean if v is None else v for v in values), 3))
    found = {
        r["meter_id"]: (r["reading_count"], round(r["total_consumption"], 3))
        for r in gold.meter_consumption(silver.to_silver(df)).collect()
    }
    assert found == expected


def test_hot_key_moves_once_per_task(spark):
    kept = silver.latest_arrival(bronze(spark, 20_000).where("meter_id = 'MTR-001'").repartition(4))
    assert kept.count() == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
