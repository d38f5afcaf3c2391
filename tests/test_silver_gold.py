import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.operators import gold, silver
from gridloom.settings import DEFAULTS

COLUMNS = (
    "meter_id string, meter_type string, region string, timestamp timestamp, energy_consumption double, "
    "voltage double, current double, power_factor double, temperature double, humidity double, "
    "weather_condition string, ingestion_ts timestamp, source_system string"
)


NOON = dt.datetime(2024, 11, 16, 12)
READING = {
    "meter_id": "MTR-310", "meter_type": "INDUSTRIAL", "region": "West", "timestamp": NOON, "energy_consumption": 14.25,
    "voltage": 241.5, "current": 61.0, "power_factor": 0.81, "temperature": 3.5, "humidity": 77.0,
    "weather_condition": "fog", "ingestion_ts": NOON, "source_system": "feed",
}


@pytest.fixture()
def bronze(spark):
    """Meter 310 sends noon three times out of order; 311 has a voltage out of bounds beside good ones; one id is malformed."""
    hour = dt.timedelta(hours=1)
    changed = [
        {"energy_consumption": 13.0, "ingestion_ts": NOON + 2 * hour},
        {"energy_consumption": 99.0, "ingestion_ts": NOON + hour},
        {},
        *(
            {"meter_id": "MTR-311", "timestamp": NOON + k * hour, "voltage": volts, "meter_type": " residential", "weather_condition": sky}
            for k, (volts, sky) in enumerate([(220.0, "RAIN"), (500.0, None), (230.0, " rain ")])
        ),
        {"meter_id": "mtr-312"},
    ]
    rows = [tuple((READING | change).values()) for change in changed]
    return spark.createDataFrame(rows, COLUMNS)


def test_of_three_arrivals_the_last_is_kept(bronze):
    kept = silver.latest_arrival(bronze).where("meter_id = 'MTR-310'").collect()
    assert [(r["energy_consumption"], r["ingestion_ts"].hour) for r in kept] == [(13.0, 14)]


def test_arrivals_at_one_moment_give_one_answer_however_they_lie(bronze):
    together = bronze.withColumn("ingestion_ts", F.lit(NOON)).where("meter_id = 'MTR-310'")
    found = [silver.latest_arrival(together.repartition(n, "energy_consumption")).collect() for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 1


def test_deduplication_limits_rows_before_the_shuffle(bronze):
    plan = silver.latest_arrival(bronze)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]


def test_impossible_voltage_takes_the_mean_of_the_possible_ones(bronze):
    rows = silver.cleaned(silver.latest_arrival(bronze)).where("meter_id = 'MTR-311'").orderBy("timestamp").collect()
    assert [r["voltage"] for r in rows] == [220.0, 225.0, 230.0]
    assert [r["weather_condition"] for r in rows] == ["Rain", "Unknown", "Rain"]
    assert {r["meter_type"] for r in rows} == {"residential"}


def test_malformed_meter_ids_go(bronze):
    assert silver.cleaned(bronze).where("meter_id = 'mtr-312'").isEmpty()


def test_impute_uses_the_meters_mean_of_valid_values(spark):
    rows = [("MTR-001", 1.0), ("MTR-001", 2.0), ("MTR-001", None), ("MTR-002", None)]
    df = spark.createDataFrame(rows, "meter_id string, energy_consumption double")
    filled = silver.filled_with_meter_means(df, ["energy_consumption"])
    assert sorted(r[1] for r in filled.where("meter_id = 'MTR-001'").collect()) == [1.0, 1.5, 2.0]
    assert filled.where("meter_id = 'MTR-002'").first()["energy_consumption"] is None


def test_calendar_of_a_saturday_noon_in_autumn(bronze):
    made = silver.to_silver(bronze).where("meter_id = 'MTR-310'").select(
        "hour", "day_of_week", "weekend_flag", "peak_hour_flag", "tariff_period", "season", "temperature_band"
    )
    assert tuple(made.first()) == (12, 7, 1, 0, "off_peak", "Autumn", "Very Cold")


def test_bands_and_seasons(spark):
    df = spark.createDataFrame([(t,) for t in (4.9, 5.0, 15.0, 25.0, 32.0, None)], "t double")
    bands = [r[0] for r in df.select(calendar.temperature_band(F.col("t"))).collect()]
    assert bands == ["Very Cold", "Cold", "Mild", "Warm", "Hot", "Hot"]
    months = spark.range(1, 13).select(calendar.season(F.col("id"))).collect()
    expected = ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Autumn"] * 3 + ["Winter"]
    assert [r[0] for r in months] == expected


def test_daily_rows_and_ranks(bronze):
    readings = silver.to_silver(bronze)
    days = {r["meter_id"]: (r["reading_count"], r["season"], r["weekend_flag"]) for r in gold.daily_consumption(readings).collect()}
    assert days == {"MTR-310": (1, "Autumn", 1), "MTR-311": (3, "Autumn", 1)}
    ranked = {r["meter_id"]: r["consumption_rank"] for r in gold.meter_consumption(readings).collect()}
    assert ranked == {"MTR-311": 1, "MTR-310": 2}


@pytest.mark.parametrize("make", [gold.daily_consumption, gold.dim_date])
def test_days_are_hash_aggregated(workspace, make):
    assert "SortAggregate" not in make(workspace.silver)._jdf.queryExecution().executedPlan().toString()


def test_totals_and_counts_agree_across_grains(workspace):
    readings = workspace.silver
    counts, totals = set(), []
    for make in (
        gold.hourly_consumption, gold.daily_consumption, gold.weekly_consumption,
        gold.monthly_consumption, gold.meter_consumption, gold.peak_offpeak_consumption, gold.weather_energy,
    ):
        found = make(readings).agg(F.sum("reading_count"), F.sum("total_consumption")).first()
        counts.add(found[0])
        totals.append(found[1])
    assert counts == {readings.count()}
    assert max(totals) - min(totals) < 0.1


def test_iso_year_moves_new_years_day(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1), 2023, "MTR-001", 1.0)], "timestamp timestamp, year int, meter_id string, energy_consumption double")
    calendar_year = gold.weekly_consumption(df).first()
    iso = gold.weekly_consumption(df, iso_year=True).first()
    assert (calendar_year["year"], calendar_year["week_of_year"]) == (2023, 52)
    assert (iso["year"], iso["week_of_year"]) == (2022, 52)


def test_silver_counts_match_the_fixture_notes(workspace):
    assert workspace.bronze.count() == 1000
    assert silver.latest_arrival(workspace.bronze).count() == 992
    assert workspace.silver.count() == 978
    assert silver.usable_rows(workspace.bronze, DEFAULTS).count() == 985
