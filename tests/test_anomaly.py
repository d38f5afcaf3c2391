import datetime as dt
import random

from pyspark.sql import functions as F

from gridloom.operators import anomaly, iforest

START = dt.datetime(2024, 5, 6)
READINGS = "timestamp timestamp, meter_id string, hour int, energy_consumption double"


def test_scores_by_hand(spark):
    """Hour 4 of one meter: median 10, median distance 2, so a unit is 2 x 1.4826."""
    values = [8.0, 12.0, 10.0, 7.0, 13.0, 10.0 + 2 * 1.4826 * 7, 10.0 - 2 * 1.4826 * 3.5]
    rows = [(START + dt.timedelta(days=d, hours=4), "MTR-520", 4, v) for d, v in enumerate(values)]
    other = [(START + dt.timedelta(days=d, hours=5), "MTR-520", 5, 400.0 + d) for d in range(3)]
    found = anomaly.zscore_anomalies(spark.createDataFrame(rows + other, READINGS)).orderBy("timestamp")
    kinds = {r["timestamp"].day - START.day: (r["anomaly_type"], r["anomaly_flag"]) for r in found.where("hour(timestamp) = 4").collect()}
    median, spread = 10.0, sorted(abs(v - 10.0) for v in values)[3] * 1.4826
    assert spread > 0
    for day, value in enumerate(values):
        score = (value - median) / spread
        flag = int(abs(score) >= 3)
        kind = "normal" if not flag else "low_consumption" if score < 0 else "sudden_spike" if score >= 6 else "high_consumption"
        assert kinds[day] == (kind, flag)
    assert found.where("hour(timestamp) = 5 AND anomaly_flag = 1").isEmpty()


def test_one_hour_of_one_meter_with_most_values(spark):
    """Medians over range-cut values equal those of whole groups."""
    number = F.col("id")
    rows = spark.range(30_000).select(
        (F.lit(START) + F.make_dt_interval(secs=number)).alias("timestamp"),
        F.when(number % 50 == 0, "MTR-002").otherwise("MTR-001").alias("meter_id"),
        F.lit(7).alias("hour"),
        F.round(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0, 3).alias("energy_consumption"),
    )
    centre = rows.groupBy("meter_id").agg(F.percentile("energy_consumption", F.lit(0.5)).alias("c"))
    spread = (
        rows.join(centre, "meter_id").groupBy("meter_id", "c").agg(F.percentile(F.abs(F.col("energy_consumption") - F.col("c")), F.lit(0.5)).alias("s"))
    )
    wanted = rows.join(spread, "meter_id").select(
        "timestamp", F.round((F.col("energy_consumption") - F.col("c")) / (F.col("s") * 1.4826), 3).alias("z")
    )
    found = anomaly.zscore_anomalies(rows).select("timestamp", F.round("anomaly_score", 3).alias("y"))
    assert found.join(wanted, "timestamp").where("abs(y - z) > 0.0011").isEmpty()
    assert found.count() == 30_000


def test_zero_spread_scores_zero(spark):
    rows = [(START + dt.timedelta(days=d), "MTR-001", 0, 1.0 if d else 50.0) for d in range(5)]
    df = spark.createDataFrame(rows, "timestamp timestamp, meter_id string, hour int, energy_consumption double")
    assert {(r["anomaly_score"], r["anomaly_flag"]) for r in anomaly.zscore_anomalies(df).collect()} == {(0.0, 0)}


def test_severity_uses_the_rounded_score(spark):
    rows = [(6.0, 1), (-6.2, 1), (5.99, 1), (4.0, 1), (3.99, 1), (9.0, 0)]
    df = spark.createDataFrame(rows, "anomaly_score double, anomaly_flag int")
    grades = [r["anomaly_severity"] for r in anomaly.with_severity(df).collect()]
    assert grades == ["high", "high", "medium", "medium", "low", "none"]


def test_forest_flags_a_strange_reading_and_about_one_percent(workspace):
    odd = {"energy_consumption": 99.9, "voltage": 270.0, "current": 100.0, "power_factor": 0.5, "temperature": 60.0, "humidity": 0.0}
    strange = (
        workspace.silver.limit(1)
        .withColumns({c: F.lit(v) for c, v in odd.items()})
        .withColumn("meter_id", F.lit("MTR-999"))
    )
    df = workspace.silver.unionByName(strange)
    found = iforest.isolation_forest_anomalies(df)
    rows = found.count()
    flagged = anomaly.flagged_only(found)
    assert rows == df.count()
    assert 0.002 * rows < flagged.count() <= 0.01 * rows + 1
    assert flagged.where("meter_id = 'MTR-999'").count() == 1
    assert found.where("anomaly_score <= 0 OR anomaly_score >= 10").count() == 0


def test_forest_is_repeatable_and_fills_gaps(workspace):
    df = workspace.silver.withColumn("humidity", F.when(F.col("hour") > 5, F.col("humidity")))
    first = iforest.IsolationForest.fit(df, trees=10, sample=64)
    again = iforest.IsolationForest.fit(df.repartition(7), trees=10, sample=64)
    assert (first.threshold == again.threshold).all() and (first.feature == again.feature).all()
    assert set(first.fill) == {"humidity"}
    assert df.select(first.score().alias("s")).where("s IS NULL OR isnan(s)").count() == 0


def test_samples_have_the_exact_size(workspace):
    rows = workspace.silver.count()
    drawn = iforest.drawn_samples(workspace.silver, ["meter_id", "timestamp"], rows, 5, 100, 42)
    assert [r["count"] for r in drawn.groupBy("tree").count().collect()] == [100] * 5
    whole = iforest.drawn_samples(workspace.silver, ["meter_id", "timestamp"], rows, 2, 5000, 42)
    assert [r["count"] for r in whole.groupBy("tree").count().collect()] == [rows] * 2


def test_both_detectors_together(workspace):
    together = anomaly.combined(
        anomaly.zscore_anomalies(workspace.silver),
        iforest.isolation_forest_anomalies(workspace.silver, trees=10),
    )
    methods = {r[0] for r in together.select("detection_method").distinct().collect()}
    assert methods == {"robust_zscore", "isolation_forest"}
    assert {r[0] for r in together.select("anomaly_severity").distinct().collect()} <= {"none", "low", "medium", "high"}
    summary = {(r["facet"], r["label"]): r["anomalies"] for r in anomaly.anomaly_summary(together).collect()}
    flagged = anomaly.flagged_only(together).count()
    assert sum(n for (facet, _), n in summary.items() if facet == "type") == flagged
    assert sum(n for (facet, _), n in summary.items() if facet == "severity") == flagged
