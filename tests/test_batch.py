import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.functions import shared
from gridloom.operators import constraints, models, silver
from gridloom.operators.quality import QualityError
from gridloom.plans import batch
from gridloom.sources import bundled, feeds, layers, schemas, warehouse
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("base"))
    feeds.write_feeds(bundled.feeds(spark, SMALL), f"{folder}/raw")
    return folder


@pytest.fixture(scope="module")
def summary(spark, base):
    sizes = models.ModelSizes(forest_trees=2, forest_depth=3, boosting_rounds=2)
    return batch.run_batch(spark, base, database="metering", sizes=sizes)


def test_csv_feeds_keep_schema_and_blanks(spark, base):
    raw = feeds.read_feeds(spark, f"{base}/raw")
    assert raw.readings.schema == schemas.READINGS and raw.meters.schema == schemas.METERS
    assert raw.readings.where("weather_condition = ' clear'").count() > 0
    assert feeds.to_bronze(raw.readings).where("timestamp IS NULL").count() == 5


def test_a_later_file_corrects_an_earlier_one(spark, tmp_path):
    """Two deliveries: the later one wins for its keys, also with smaller values and where its file sorts first."""
    given = bundled.feeds(spark, SMALL)
    usable = given.readings.where("meter_id LIKE 'MTR-___' AND timestamp != 'bad-ts' AND energy_consumption IS NOT NULL")
    usable = usable.dropDuplicates(["meter_id", "timestamp"]).limit(40)
    first = usable.withColumn("energy_consumption", F.lit(90.0))
    again = usable.orderBy("meter_id", "timestamp").limit(15).withColumn("energy_consumption", F.lit(2.0))
    feeds.write_feeds(given._replace(readings=first), f"{tmp_path}/raw")
    feeds.deliver(again, f"{tmp_path}/raw")
    raw = feeds.read_feeds(spark, f"{tmp_path}/raw").readings
    bronze = feeds.to_bronze(raw, feeds.file_arrival())
    assert bronze.count() == 55 and bronze.select("ingestion_ts").distinct().count() >= 2
    kept = silver.latest_arrival(bronze).groupBy("energy_consumption").count().collect()
    assert {r["energy_consumption"]: r["count"] for r in kept} == {2.0: 15, 90.0: 25}
    layers.write_by_day(bronze, f"{tmp_path}/bronze", "event_date")  # the arrival is stored with the row
    stored = silver.latest_arrival(layers.read(spark, f"{tmp_path}/bronze"))
    assert stored.where("energy_consumption = 2").count() == 15


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = f"{tmp_path}/layer"
    layers.write_dataset(spark.range(5), path)
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stopped"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        layers.write_dataset(broken, path)
    assert layers.read(spark, path).count() == 5 and os.listdir(tmp_path) == ["layer"]
    layers.write_dataset(spark.range(7), path)
    assert layers.read(spark, path).count() == 7 and os.listdir(tmp_path) == ["layer"]


def test_tables_keep_their_declared_types_and_old_versions(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS declared")
    row = "DATE'2023-01-01' AS date_key, 'peak' AS tariff_period, {} AS total_consumption, 2.5D AS avg_consumption, 3L AS reading_count"
    load = lambda value: warehouse.load_table(spark.range(1).selectExpr(*row.format(value).split(", ")), "declared", "fact_peak_offpeak", str(tmp_path))
    load("12.34567D")
    table = spark.table("declared.fact_peak_offpeak")
    assert table.dtypes == [
        ("date_key", "date"), ("tariff_period", "string"), ("total_consumption", "decimal(14,4)"),
        ("avg_consumption", "decimal(12,4)"), ("reading_count", "int"),
    ]
    assert str(table.first()["total_consumption"]) == "12.3457"
    for wrong in ("1e12D", "CAST(NULL AS DOUBLE)"):  # an overflow, a missing value
        with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|is NULL"):
            load(wrong)
    with pytest.raises(ValueError, match="lacks avg_consumption"):
        warehouse.conformed(spark.range(1).selectExpr("1 AS total_consumption", "current_date() AS date_key", "'peak' AS tariff_period", "1 AS reading_count"), "fact_peak_offpeak")
    with pytest.raises(Exception, match="too long"):
        warehouse.load_table(spark.range(1).selectExpr(*row.format("1.0D").replace("peak", "p" * 17).split(", ")), "declared", "fact_peak_offpeak", str(tmp_path))
    assert str(spark.table("declared.fact_peak_offpeak").first()["total_consumption"]) == "12.3457"
    open_reader = spark.table("declared.fact_peak_offpeak")
    load("7.0D")
    assert str(spark.table("declared.fact_peak_offpeak").first()["total_consumption"]) == "7.0000"
    assert str(open_reader.first()["total_consumption"]) in ("12.3457", "7.0000")  # whichever, but whole


def test_old_versions_go_by_age(spark, tmp_path, monkeypatch):
    spark.sql("CREATE DATABASE IF NOT EXISTS declared")
    df = spark.range(1).selectExpr("DATE'2023-01-01' AS date_key", "'peak' AS tariff_period", "1D AS total_consumption", "1D AS avg_consumption", "1 AS reading_count")
    load = lambda: warehouse.load_table(df, "declared", "fact_peak_offpeak", str(tmp_path))
    load()
    load()
    assert len(os.listdir(f"{tmp_path}/fact_peak_offpeak")) >= 2
    monkeypatch.setattr(warehouse, "KEEP_SECONDS", -1)
    load()
    assert len([n for n in os.listdir(f"{tmp_path}/fact_peak_offpeak") if n.startswith("v")]) == 1


def test_reads_of_one_meter_skip_row_groups(spark, tmp_path, workspace):
    """Rows of a meter lie together, and its bloom filter rules out other row groups."""
    spark.sql("CREATE DATABASE IF NOT EXISTS declared")
    warehouse.load_table(workspace.warehouse("fact_hourly_consumption"), "declared", "fact_hourly_consumption", str(tmp_path))
    table = spark.table("declared.fact_hourly_consumption")
    one = table.select("meter_id").first()["meter_id"]
    assert 0 < table.where(F.col("meter_id") == one).count() < table.count()
    files = [f"{d}/{n}" for d, _, names in os.walk(tmp_path) for n in names if n.endswith(".parquet")]
    for file in files:
        meta = pq.ParquetFile(file)
        ids = meta.read(columns=["meter_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
        place = meta.schema_arrow.names.index("meter_id")
        statistics = meta.metadata.row_group(0).column(place).statistics
        assert (statistics.min, statistics.max) == (ids[0], ids[-1])
    plan = table.where(F.col("meter_id") == one)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(meter_id,{one})" in plan


def test_unreadable_numbers_become_missing(spark, tmp_path):
    os.makedirs(tmp_path / "weather.csv")
    (tmp_path / "weather.csv" / "part.csv").write_text("timestamp,temperature,humidity,weather_condition\n2023-01-01 00:00:00,warm,40.5,Rain\n")
    for name in ("energy_readings.csv", "meter_info.csv"):
        (tmp_path / name).write_text("")
    row = feeds.weather_to_bronze(feeds.read_feeds(spark, str(tmp_path)).weather).first()
    assert row["temperature"] is None and row["humidity"] == 40.5 and row["timestamp"].year == 2023


def test_batch_builds_every_dataset(summary):
    assert summary["profile_missing"] == []
    assert summary["silver"]["passed"] and summary["silver"]["total_rows"] == 978
    assert summary["gold"]["wide_fact"] == summary["gold"]["hourly_consumption"]
    assert summary["gold"]["dim_meter"] == 150


def test_batch_leaves_layers_reports_and_csv(spark, base, summary):
    assert any(name.startswith("event_date=") for name in os.listdir(f"{base}/bronze/energy_readings"))
    assert any(name.startswith("date=") for name in os.listdir(f"{base}/silver/energy_readings"))
    csv = spark.read.csv(f"{base}/gold/daily_consumption.csv", header=True)
    assert csv.count() == summary["gold"]["daily_consumption"]
    assert spark.read.json(f"{base}/reports/gold_row_counts").count() == 14
    assert spark.read.json(f"{base}/reports/profile/anomalies").count() == 8


def test_catalog_and_warehouse(spark, summary):
    assert spark.table("metering.silver_energy_readings").where("date = '2023-03-04'").count() > 0
    assert set(summary["warehouse"]) == set(constraints.RULES)
    assert spark.table("metering.fact_anomalies").where("anomaly_flag = 0").count() == 0
    tables = {name: spark.table(f"metering.{name}") for name in summary["warehouse"]}
    found = constraints.check_constraints(tables)
    assert found.where("violations > 0").count() == 0 and found.count() > 90


def test_batch_can_be_repeated_with_the_saved_model(spark, base, summary):
    again = batch.run_batch(spark, base, train=False)
    assert again["gold"]["predictions"] == summary["gold"]["predictions"]
    assert again["gold"]["daily_consumption"] == summary["gold"]["daily_consumption"]


def test_strict_stops_before_publishing(spark, base, tmp_path):
    feeds.write_feeds(bundled.feeds(spark, SMALL), f"{tmp_path}/raw")
    with pytest.raises(QualityError):
        batch.run_batch(spark, str(tmp_path), strict=True)
    assert not os.path.exists(f"{tmp_path}/bronze")


def test_a_day_is_written_in_few_files(base, summary):
    for layer, day in (("bronze", "event_date="), ("silver", "date=")):
        folder = f"{base}/{layer}/energy_readings"
        days = [name for name in os.listdir(folder) if name.startswith(day)]
        files = [n for name in days for n in os.listdir(f"{folder}/{name}") if n.endswith(".parquet")]
        assert len(files) <= 2 * len(days)


def test_shared_folder_follows_the_session(spark):
    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(5)
    assert shared.stored(df, "x").count() == 5
