"""Wide fact, views, reads, metrics, constraints and profile."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.operators import constraints, metrics, profile, reads, reports, views, widefact


@pytest.fixture(scope="module")
def fact(workspace):
    return stored(workspace.wide_fact, "fact")


def test_wide_fact_contract(fact, workspace):
    assert len(fact.columns) == 25
    assert fact.count() == fact.select(*widefact.KEY).distinct().count() == workspace.silver.count()
    assert fact.where("anomaly_flag NOT IN (0, 1) OR total_consumption IS NULL").count() == 0
    assert {r[0] for r in fact.select("anomaly_severity").distinct().collect()} <= {"none", "low", "medium", "high"}


def test_wide_fact_without_optional_parts(workspace):
    plain = widefact.wide_fact(workspace.gold("hourly_consumption"), workspace.silver)
    assert "predicted_consumption" not in plain.columns and "anomaly_score" not in plain.columns
    assert {tuple(r) for r in plain.select("anomaly_flag", "anomaly_type", "anomaly_severity").distinct().collect()} == {(0, "normal", "none")}
    assert widefact.wide_fact_summary(plain).first()["predicted_rows"] == 0


def test_wide_fact_keeps_one_row_per_hour_for_finer_readings(spark):
    rows = [(dt.datetime(2023, 1, 1, 5, m), "MTR-001", float(m)) for m in (45, 15, 30)]
    base = spark.createDataFrame(rows, "timestamp timestamp, meter_id string, temperature double")
    feature_rows = base.withColumns({c: F.lit(None).cast("string") for c in widefact.CONTEXT if c != "temperature"})
    hourly = spark.createDataFrame([(dt.date(2023, 1, 1), 5, "MTR-001", 3.0)], "date date, hour int, meter_id string, total_consumption double")
    scored = [(dt.datetime(2023, 1, 1, 5, 15), "MTR-001", 0, "normal", 1.0, "none"), (dt.datetime(2023, 1, 1, 5, 30), "MTR-001", 1, "low_consumption", -7.0, "high")]
    anomalies = spark.createDataFrame(scored, "timestamp timestamp, meter_id string, anomaly_flag int, anomaly_type string, anomaly_score double, anomaly_severity string")
    row = widefact.wide_fact(hourly, feature_rows, anomalies=anomalies).collect()
    assert len(row) == 1 and row[0]["temperature"] == 15.0
    assert (row[0]["anomaly_flag"], row[0]["anomaly_type"], row[0]["anomaly_score"]) == (1, "low_consumption", -7.0)


def test_labels(fact):
    rows = widefact.labelled_fact(fact).select("total_consumption", "consumption_band", "hour", "hour_label").collect()
    for r in rows:
        limit = {"Low": (0, 2), "Medium": (2, 6), "High": (6, 12), "Very High": (12, 1e9)}[r["consumption_band"]]
        assert limit[0] <= r["total_consumption"] < limit[1] and r["hour_label"] == f"{r['hour']:02d}:00"


def test_views_register_and_rank(spark, workspace):
    tables = {name: workspace.warehouse(name) for name in ("fact_meter_consumption", "fact_daily_consumption")}
    made = views.register_views(tables)
    assert "vw_meter_ranking" in made and "vw_anomaly_counts" not in made
    ranking = spark.table("vw_meter_ranking").collect()
    assert sorted(r["consumption_rank"] for r in ranking) == list(range(1, len(ranking) + 1))
    assert spark.table("vw_top_meters").count() == 5


def test_region_rank_shares_ties(spark):
    rows = [("a", "N", 5.0, 1), ("b", "N", 5.0, 2), ("c", "N", 4.0, 3), ("d", None, 1.0, 4)]
    df = spark.createDataFrame(rows, "meter_id string, region string, total_consumption double, consumption_rank int")
    for c in ("meter_type", "avg_consumption", "max_consumption", "min_consumption"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    found = {r["meter_id"]: r["region_rank"] for r in views.meter_ranking(df).collect()}
    assert found == {"a": 1, "b": 1, "c": 3, "d": 1}


def test_tariff_share_of_nothing_is_missing(spark):
    df = spark.createDataFrame([("peak", 0.0, 0.0, 1)], "tariff_period string, total_consumption double, avg_consumption double, reading_count long")
    assert views.peak_offpeak(df).first()["pct_of_total"] is None


@pytest.mark.parametrize("limit", [0, 5001, "many", None, -3])
def test_limits_are_checked(workspace, limit):
    with pytest.raises(ValueError):
        reads.read_daily(workspace.warehouse("fact_daily_consumption"), limit=limit)


def test_reads_validate_and_filter(workspace):
    anomalies = workspace.warehouse("fact_anomalies")
    with pytest.raises(ValueError):
        reads.read_anomalies(anomalies, severity="extreme")
    high = reads.read_anomalies(anomalies, severity="high", limit="7").collect()
    assert len(high) == 7 and {r["anomaly_severity"] for r in high} == {"high"}
    assert [r["reading_ts"] for r in high] == sorted((r["reading_ts"] for r in high), reverse=True)
    with pytest.raises(reads.NotFound):
        reads.read_meter(workspace.warehouse("fact_meter_consumption"), "MTR-998", must_exist=True)


def test_metric_slices_and_empty_fact(fact, workspace):
    whole = metrics.measure(fact).first()
    by_meter = metrics.measure(fact, ["total_energy_consumption", "total_readings"], ["meter_id"])
    assert by_meter.agg(F.sum("total_readings")).first()[0] == whole["total_readings"]
    one = metrics.sliced(fact, dates=("2023-02-01", "2023-02-28"), severities=["high"])
    assert one.where("month(date) != 2 OR anomaly_severity != 'high'").count() == 0
    empty = metrics.measure(fact.where("false")).first()
    assert empty["anomaly_rate_pct"] == 0.0 and empty["peak_consumption_share_pct"] == 0.0


def test_month_over_month_needs_the_previous_calendar_month(spark):
    rows = [(dt.datetime(2023, m, 3), "N", v) for m, v in ((1, 10.0), (2, 15.0), (4, 30.0))]
    df = spark.createDataFrame(rows, "date timestamp, region string, total_consumption double")
    found = {r["month_start"].month: r["consumption_mom_pct"] for r in metrics.month_over_month(df, ["region"]).collect()}
    assert found == {1: 0.0, 2: 50.0, 4: 0.0}


def test_rolling_days_skip_gaps_by_calendar(spark):
    rows = [(dt.datetime(2023, 1, d), 1.0) for d in (1, 2, 7, 8, 20)]
    df = spark.createDataFrame(rows, "date timestamp, total_consumption double")
    found = {r["day"].day: r["rolling_7d_consumption"] for r in metrics.rolling_days(df).collect()}
    assert found == {1: 1.0, 2: 2.0, 7: 3.0, 8: 3.0, 20: 1.0}


def test_drill_down_totals_agree(workspace):
    rows = reports.drill_down(workspace.gold("meter_consumption")).groupBy("depth").agg(F.sum("reading_count").alias("n")).collect()
    assert {r["depth"] for r in rows} == {0, 1, 3, 7} and len({r["n"] for r in rows}) == 1


def test_constraints_find_what_is_wrong(spark):
    day = dt.date(2023, 1, 1)
    tables = {
        "dim_date": spark.createDataFrame([(day, 2023, 1, 13, 1, 1, 0, "Winter"), (day, 2023, 1, 1, 1, 1, 2, None)], "date_key date, year int, quarter int, month int, day int, day_of_week int, weekend_flag int, season string"),
        "fact_peak_offpeak": spark.createDataFrame([(day, "peak", 1.0, 1.0, 1), (day, "night", 1.0, None, 1), (dt.date(2024, 1, 1), "peak", 1.0, 1.0, 1), (dt.date(2024, 1, 1), "off_peak", 1.0, 1.0, 1)], "date_key date, tariff_period string, total_consumption double, avg_consumption double, reading_count long"),
    }
    found = {(r["table_name"], r["constraint_name"]): r["violations"] for r in constraints.check_constraints(tables).where("violations > 0").collect()}
    assert found == {
        ("dim_date", "primary_key"): 1,
        ("dim_date", "check_month_range"): 1,
        ("dim_date", "check_weekend_flag_domain"): 1,
        ("dim_date", "not_null_season"): 1,
        ("fact_peak_offpeak", "check_tariff_period_domain"): 1,
        ("fact_peak_offpeak", "not_null_avg_consumption"): 1,
        ("fact_peak_offpeak", "foreign_key_date_key"): 2,
    }


def test_orphans_count_rows_and_ignore_missing_references(spark):
    fact = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "meter_id string")
    dim = spark.createDataFrame([("a",)], "meter_id string")
    assert [tuple(r) for r in constraints.orphans(fact, "meter_id", dim, "meter_id").collect()] == [("b", 2)]


def test_relationship_cardinality(spark):
    link = constraints.Relationship(("m", "k"), ("d", "k"), "one-to-one")
    many = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    one = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    row = constraints.check_relationships({"m": many, "d": one}, [link]).first()
    assert (row["repeated_many"], row["repeated_one"], row["unresolved"]) == (1, 1, 1)


def test_profile_counts_surplus_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    rows = {r["column_name"]: r for r in profile.profile(df, "demo").collect()}
    assert rows["b"]["null_count"] == 3 and rows["a"]["null_count"] == 0
    assert (rows["a"]["row_count"], rows["a"]["duplicate_rows"], rows["b"]["data_type"]) == (4, 2, "string")
    assert profile.missing_datasets({"wide_fact": df}, ["wide_fact", "anomalies"]) == ["anomalies"]


@pytest.mark.parametrize("digest", [profile.row_digest, lambda columns: F.lit(1), lambda columns: F.length(F.col("a"))])
def test_repeated_rows_do_not_depend_on_digests(spark, digest):
    rows = [("x", None, 1.0), ("x", None, 1.0), (None, "x", 1.0), ("yy", "z", None), ("yy", "z", None), ("yy", "z", None), ("w", "", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, c double")
    assert profile.repeated_rows(df, digest).scalar is not None
    assert profile.repeated_rows(df, digest).first()["duplicate_rows"] == 3
    assert profile.repeated_rows(df.dropDuplicates(), digest).first()["duplicate_rows"] == 0


def test_a_profile_moves_digests_only(spark):
    wide = spark.range(2000).select("id", *(F.repeat(F.col("id").cast("string"), F.lit(20)).alias(f"c{k}") for k in range(6)))
    keyed = wide.withColumn("_digest", profile.row_digest(wide.columns)).groupBy("_digest").count()
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    exchanged = next(line for line in plan.splitlines() if "HashAggregate" in line and "partial_count" in line)
    assert "c0" not in exchanged
    assert profile.profile(wide, "wide").where("row_count = 2000 AND duplicate_rows = 0 AND null_count = 0").count() == 7
