import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import features, split
from gridloom.settings import Settings


def readings(meters, hours, keep, seed):
    rng = random.Random(seed)
    start = dt.datetime(2023, 1, 1)
    return [
        (start + dt.timedelta(hours=h), f"MTR-{m:03d}", round(rng.random() * 9, 2))
        for m in range(meters)
        for h in range(hours)
        if rng.random() < keep or m == 0
    ]


def expected(rows):
    """Plain pandas per meter."""
    df = pd.DataFrame(rows, columns=["timestamp", "meter_id", "energy_consumption"])
    df = df.sort_values(["meter_id", "timestamp"])
    by_meter = df.groupby("meter_id")["energy_consumption"]
    for k in (1, 2, 3, 24):
        df[f"lag_{k}h"] = by_meter.shift(k)
    for w in (3, 24):
        past = by_meter.shift(1)
        rolled = past.groupby(df["meter_id"]).rolling(w, min_periods=1)
        df[f"rolling_mean_{w}h"] = rolled.mean().reset_index(level=0, drop=True)
        rolled = past.groupby(df["meter_id"]).rolling(w, min_periods=2)
        df[f"rolling_std_{w}h"] = rolled.std().reset_index(level=0, drop=True)
    return df.reset_index(drop=True)


@pytest.mark.parametrize("segment_days, keep", [(366, 0.9), (3, 0.9), (1, 0.9), (1, 0.1), (7, 0.02)])
def test_history_crosses_segment_borders_exactly(spark, segment_days, keep):
    rows = readings(4, 24 * 15, keep, seed=segment_days)
    df = spark.createDataFrame(rows, "timestamp timestamp, meter_id string, energy_consumption double")
    found = (
        features.with_history(df.repartition(6), segment_days=segment_days)
        .toPandas()
        .sort_values(["meter_id", "timestamp"])
        .reset_index(drop=True)
    )
    wanted = expected(rows)
    assert len(found) == len(wanted)
    for name in features.history_names():
        np.testing.assert_allclose(found[name].astype(float), wanted[name].astype(float), atol=1e-9, err_msg=name)


def test_history_reads_its_input_once(spark):
    rows = readings(2, 24 * 4, 1.0, seed=1)
    df = spark.createDataFrame(rows, "timestamp timestamp, meter_id string, energy_consumption double")
    made = features.with_history(df, segment_days=1)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_only_absent_columns_are_added_with_full_frames(spark):
    rows = readings(1, 30, 1.0, seed=5)
    df = spark.createDataFrame(rows, "timestamp timestamp, meter_id string, energy_consumption double")
    df = df.withColumn("lag_1h", F.lit(-1.0))
    made = features.with_missing_history(df).orderBy("timestamp").collect()
    assert {r["lag_1h"] for r in made} == {-1.0}
    assert [r["rolling_mean_3h"] is None for r in made[:5]] == [True, True, True, False, False]


def test_cycles(spark):
    """Neighbours across the end of a cycle are as far apart as any other neighbours."""
    df = spark.range(24).select(
        F.col("id").cast("int").alias("hour"), (F.col("id") % 12 + 1).cast("int").alias("month"), (F.col("id") % 7 + 1).cast("int").alias("day_of_week")
    )
    rows = features.with_cycles(df).orderBy("hour").collect()
    for prefix, period in (("hour", 24), ("month", 12), ("dow", 7)):
        points = [np.array([r[f"{prefix}_sin"], r[f"{prefix}_cos"]]) for r in rows[:period]]
        steps = [np.linalg.norm(points[k] - points[k - 1]) for k in range(period)]
        assert max(steps) == pytest.approx(min(steps)) == pytest.approx(2 * np.sin(np.pi / period))


def test_matrix_has_every_level_once(workspace):
    levels = features.category_levels(workspace.silver)
    matrix = features.feature_matrix(workspace.features, levels)
    width = 11 + 8 + 6 + sum(map(len, levels.values()))
    assert len(matrix.columns) == width + 3
    one_hot = sum(F.col(f"meter_type_{v}") for v in levels["meter_type"])
    assert matrix.where(one_hot != 1).count() == 0


def test_three_hundred_levels_are_all_columns(spark, workspace):
    many = workspace.features.withColumn("weather_condition", F.concat(F.lit("sky "), (F.xxhash64("timestamp", "meter_id") % 300).cast("string")))
    levels = features.category_levels(many)
    assert len(levels["weather_condition"]) > 200
    assert levels["weather_condition"] == sorted(levels["weather_condition"])


@pytest.mark.parametrize("test_size", [0.2, 0.25, 0.5, 0.0, 1.0])
def test_split_equals_sorting_everything(spark, test_size):
    rng = random.Random(8)
    keys = {
        (dt.datetime(2023, 1, 1 + rng.randrange(3), rng.randrange(24), 0, 0, rng.choice([0, 0, 250])), f"MTR-{rng.randrange(40):03d}")
        for _ in range(700)
    }
    df = spark.createDataFrame(sorted(keys, key=lambda k: rng.random()), "timestamp timestamp, meter_id string")
    train, test = split.chronological_split(df, test_size)
    ordered = sorted(keys)
    cut = int(len(ordered) * (1 - test_size))
    assert sorted(map(tuple, train.collect())) == ordered[:cut]
    assert sorted(map(tuple, test.collect())) == ordered[cut:]


def test_split_with_all_rows_at_one_moment(spark):
    rows = [(dt.datetime(2023, 1, 1), f"MTR-{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "timestamp timestamp, meter_id string")
    boundary = split.find_boundary(df, 0.2)
    assert (boundary.train_rows, boundary.test_rows, boundary.last_meter) == (160, 40, "MTR-159")
    assert df.where(boundary.in_training()).count() == 160


def test_settings_drive_the_columns(spark):
    settings = Settings(lags=(1, 5), rolling_windows=(2,))
    assert features.history_names(settings) == ["lag_1h", "lag_5h", "rolling_mean_2h", "rolling_std_2h"]
