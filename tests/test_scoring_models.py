import datetime as dt
import threading

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from gridloom.operators import features, models, scoring

SIZES = models.ModelSizes(forest_trees=3, forest_depth=4, boosting_rounds=3)


@pytest.fixture(scope="module")
def table(workspace):
    return workspace.feature_table


@pytest.fixture(scope="module")
def training(table):
    return models.train(table, sizes=SIZES)


def metrics(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, p double")
    return scoring.regression_metrics(df, "a", "p").first().asDict()


def test_metrics_by_hand(spark):
    """Errors 3, -1, 0 and 2 around actuals 2, 6, 10 and 30 (mean 12, variance 116)."""
    found = metrics(spark, [(2.0, 5.0), (6.0, 5.0), (10.0, 10.0), (30.0, 32.0)])
    assert found == {"mae": 1.5, "mse": 3.5, "rmse": round(3.5**0.5, 5), "r2": round(1 - 3.5 / 116, 5)}


def test_forecasting_the_mean_explains_nothing(spark):
    assert metrics(spark, [(1.0, 4.0), (7.0, 4.0)])["r2"] == 0.0


def test_error_columns(spark):
    rows = [(dt.datetime(2023, 1, 1), "MTR-001", 2.0, 2.5), (dt.datetime(2023, 1, 1), "MTR-002", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp, meter_id string, energy_consumption double, prediction double")
    made = {r["meter_id"]: r for r in scoring.with_errors(df, scoring.Persistence()).collect()}
    assert made["MTR-001"]["prediction_error"] == 0.5 and made["MTR-001"]["abs_percentage_error"] == 25.0
    assert made["MTR-002"]["abs_percentage_error"] == 0.0


def test_training_compares_three_and_picks_the_lowest_rmse(training, table):
    rows = training.metrics.collect()
    assert {r["model_name"] for r in rows} == {"LinearRegression", "RandomForest", "GradientBoosting"}
    chosen = [r for r in rows if r["selected"]]
    assert len(chosen) == 1 and chosen[0]["rmse"] == min(r["rmse"] for r in rows)
    seen = features.category_levels(features.model_rows(table).where(training.boundary.in_training()))
    assert {r["feature_count"] for r in rows} == {11 + 8 + 6 + sum(map(len, seen.values()))}
    assert rows[0]["train_rows"] == int((rows[0]["train_rows"] + rows[0]["test_rows"]) * 0.8)


def test_candidates_are_fitted_side_by_side(table, monkeypatch):
    """Every fit waits for the other two, so fitting one after another would never end."""
    together, fit, names = threading.Barrier(3), Pipeline.fit, []

    def waiting(pipeline, rows, params=None):
        if len(pipeline.getStages()) < 3:  # not the encoding
            together.wait(timeout=60)
            names.append(type(pipeline.getStages()[-1]).__name__)
        return fit(pipeline, rows, params)

    monkeypatch.setattr(Pipeline, "fit", waiting)
    made = models.train(table, sizes=SIZES)
    assert sorted(names) == ["GBTRegressor", "LinearRegression", "RandomForestRegressor"]
    assert [r["model_name"] for r in made.metrics.collect()] == ["LinearRegression", "RandomForest", "GradientBoosting"]


def test_the_forest_keeps_the_nodes_of_rows():
    assert models.candidates()["RandomForest"].getStages()[0].getCacheNodeIds()


def test_saved_model_answers_like_the_fitted_one(spark, training, table, tmp_path):
    folder = str(tmp_path / "models")
    models.save(training, folder)
    loaded = models.load_best(spark, folder)
    assert loaded.name == training.best.name
    again = models.evaluate_saved(spark, folder, table).first()
    kept = training.metrics.where("selected").first()
    assert (again["rmse"], again["mae"]) == (kept["rmse"], kept["mae"])


def test_an_unknown_category_is_all_zeros(training, table):
    rows = features.model_rows(table).limit(5).withColumn("weather_condition", F.lit("Hail"))
    vector = training.best.transform(rows).first()["features"]
    assert sum(vector.toArray()[-5:]) == 0


def test_last_rows_only(table):
    kept = models.last_rows(table, 10).collect()
    newest = table.orderBy(F.desc("timestamp"), F.desc("meter_id")).limit(10).collect()
    assert sorted(kept) == sorted(newest)


def request_rows(spark, rows):
    return spark.createDataFrame(rows, "timestamp string, meter_id string, temperature double, humidity double, lag_24h double")


def test_requests_are_scored_or_rejected_with_a_reason(spark, table):
    known = table.dropna(subset=features.history_names()).agg(F.max("meter_id")).first()[0]
    last = table.where(F.col("meter_id") == known).orderBy(F.desc("timestamp")).first()
    rows = [
        ("2024-01-01 10:00:00", known, 10.0, 50.0, None),
        ("2024-01-02 10:00:00", known, 10.0, 50.0, 4.5),
        ("2024-01-01 10:00:00", "MTR-999", 10.0, 50.0, None),
        ("2024-01-01 10:00:00", known, None, 50.0, None),
        ("yesterday", known, 1.0, 50.0, None),
    ]
    answers, rejected = scoring.predict_requests(request_rows(spark, rows), table, scoring.Persistence())
    found = {r["timestamp"].day: r["predicted_consumption"] for r in answers.collect()}
    assert found == {1: round(last["lag_24h"], 4), 2: 4.5}
    assert sorted(r["reason"] for r in rejected.collect()) == [
        "missing: temperature", "timestamp not readable", "unknown meter",
    ]


def test_fields_that_are_no_numbers_are_rejected(spark, table):
    known = table.dropna(subset=features.history_names()).agg(F.max("meter_id")).first()[0]
    rows = [
        ("2024-01-01 10:00:00", known, "10.5", "50", None), ("2024-01-01 11:00:00", known, "warm", "50", None),
        ("2024-01-01 12:00:00", known, "1", "50", "x"), ("2024-01-01 13:00:00", known, "NaN", "wet", "230"),
    ]
    asked = spark.createDataFrame(rows, "timestamp string, meter_id string, temperature string, humidity string, voltage string")
    answers, rejected = scoring.predict_requests(asked, table, scoring.Persistence())
    assert [r["timestamp"].hour for r in answers.collect()] == [10]
    assert {(r["timestamp"][11:13], r["reason"]) for r in rejected.collect()} == {
        ("11", "not a number: temperature"), ("12", "not a number: voltage"), ("13", "not a number: temperature,humidity"),
    }


def test_a_meter_without_voltage_trains_and_scores(table):
    meter = table.dropna(subset=features.history_names()).agg(F.min("meter_id")).first()[0]
    holes = table.withColumn("voltage", F.when(F.col("meter_id") != meter, F.col("voltage")))
    best = models.train(holes, sizes=SIZES).best
    scored = best.transform(features.model_rows(holes).where(F.col("meter_id") == meter))
    assert scored.count() > 0 and scored.where("prediction IS NULL OR isnan(prediction)").isEmpty()


def test_recomputed_lags_follow_the_last_reading(spark, table):
    known = table.dropna(subset=features.history_names()).agg(F.max("meter_id")).first()[0]
    history = table.where(F.col("meter_id") == known).orderBy(F.desc("timestamp")).limit(24).collect()
    rows = request_rows(spark, [("2024-01-01 10:00:00", known, 10.0, 50.0, None)])
    answers, _ = scoring.predict_requests(rows, table, scoring.Persistence(), recompute=True)
    assert answers.first()["predicted_consumption"] == round(history[23]["energy_consumption"], 4)


def test_requests_work_with_a_fitted_model(spark, training, table):
    known = table.dropna(subset=features.history_names()).agg(F.max("meter_id")).first()[0]
    rows = request_rows(spark, [("2024-07-01 10:00:00", known, 10.0, 50.0, None)])
    answer = scoring.predict_requests(rows, table, training.best)[0].first()
    assert answer["predicted_consumption"] is not None and answer["model_name"] == training.best.name


def test_absent_feature_columns_count_zero(spark, workspace):
    """A model scores rows that lack a number as if it were 0.0, and rows that lack a category as of no known level."""
    rows = features.model_rows(workspace.feature_table)
    best = models.train(workspace.feature_table, names=("LinearRegression",)).best
    zeroed = rows.withColumn("humidity", F.lit(0.0)).withColumn("region", F.lit("nowhere"))
    def made(df):
        scored = best.transform(df).select("timestamp", "meter_id", F.round("prediction", 6).alias("p"))
        return sorted(map(tuple, scored.collect()))

    assert made(rows.drop("humidity", "region")) == made(zeroed) != made(rows)
