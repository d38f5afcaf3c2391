"""Training, choosing, saving and loading forecast models with Spark ML."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.operators import features
from gridloom.operators.forest import RandomForestRegressor
from gridloom.operators.scoring import PREDICTION, regression_metrics
from gridloom.operators.split import Boundary, find_boundary
from gridloom.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class ModelSizes:
    """Tree model sizes, by default the published ones."""

    forest_trees: int = 200
    forest_depth: int = 18
    forest_leaf: int = 2
    boosting_rounds: int = 250
    boosting_rate: float = 0.08
    boosting_depth: int = 4


@dataclass(frozen=True)
class FittedForecast:
    name: str
    model: PipelineModel

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(features.aligned(rows))


@dataclass(frozen=True)
class Training:
    """Everything one training run yields."""

    best: FittedForecast
    fitted: Mapping[str, FittedForecast]
    metrics: DataFrame
    boundary: Boundary
    test_rows: DataFrame


def encoding(settings: Settings = DEFAULTS) -> Pipeline:
    """Feature rows to a vector: numbers, gaps filled with the training median, one slot per category level.

    Levels are those of the rows it is fitted on; any other becomes all zeros. Medians are exact to
    a thousandth of the rows' ranks.
    """
    numbers = features.numeric_columns(settings)
    indexed = [f"_{c}_index" for c in features.CATEGORICAL]
    slots = [f"_{c}_slots" for c in features.CATEGORICAL]
    filled = [f"_{c}_filled" for c in numbers]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=list(features.CATEGORICAL), outputCols=indexed, handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=slots, dropLast=True),
            Imputer(inputCols=numbers, outputCols=filled, strategy="median", relativeError=0.001),
            VectorAssembler(inputCols=[*filled, *slots], outputCol="features"),
        ]
    )


def candidates(settings: Settings = DEFAULTS, sizes: ModelSizes = ModelSizes()) -> dict[str, Pipeline]:
    """What is fitted on encoded rows."""
    target = {"labelCol": features.TARGET, "predictionCol": PREDICTION}
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    linear = LinearRegression(featuresCol="scaled", regParam=0.0, **target)
    forest = RandomForestRegressor(
        numTrees=sizes.forest_trees,
        maxDepth=sizes.forest_depth,
        minInstancesPerNode=sizes.forest_leaf,
        featureSubsetStrategy="all",
        cacheNodeIds=True,  # rows travel with their node, trees are not walked again on every level
        seed=settings.seed,
        **target,
    )
    boosting = GBTRegressor(
        maxIter=sizes.boosting_rounds,
        stepSize=sizes.boosting_rate,
        maxDepth=sizes.boosting_depth,
        seed=settings.seed,
        **target,
    )
    return {
        "LinearRegression": Pipeline(stages=[scaler, linear]),
        "RandomForest": Pipeline(stages=[forest]),
        "GradientBoosting": Pipeline(stages=[boosting]),
    }


def last_rows(df: DataFrame, count: int) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.desc("meter_id")).limit(count)


def train(
    feature_rows: DataFrame,
    settings: Settings = DEFAULTS,
    sizes: ModelSizes = ModelSizes(),
    *,
    sample_rows: int | None = None,
    names: Collection[str] | None = None,
) -> Training:
    """Fit every candidate (or those in ``names``) on the earlier rows, compare them on the later ones, pick by RMSE.

    Encoding is learnt on the earlier rows and applied once; all three fits read the stored vectors. They run side by
    side, as the many short jobs of boosting leave most cores idle.
    """
    used = feature_rows if sample_rows is None else last_rows(feature_rows, sample_rows)
    complete = stored(features.model_rows(used, settings), "model-rows")
    boundary = find_boundary(complete, settings.test_size)
    training = complete.where(boundary.in_training())
    test = complete.where(~boundary.in_training())
    encoder = encoding(settings).fit(training)
    encoded = stored(
        encoder.transform(complete).select("timestamp", "meter_id", features.TARGET, "features"), "encoded-rows"
    )
    seen, unseen = encoded.where(boundary.in_training()), encoded.where(~boundary.in_training())

    wanted = {n: p for n, p in candidates(settings, sizes).items() if names is None or n in names}

    def fit(pipeline: Pipeline) -> tuple[PipelineModel, Row]:
        model = pipeline.fit(seen)
        return model, regression_metrics(model.transform(unseen), features.TARGET, PREDICTION).first()

    with ThreadPoolExecutor(max(1, len(wanted))) as pool:
        own = inheritable_thread_target(seen.sparkSession)(fit)
        started = {n: pool.submit(copy_context().run, own, p) for n, p in wanted.items()}
        made = {n: done.result() for n, done in started.items()}
    fitted = {n: FittedForecast(n, PipelineModel([*encoder.stages, *m.stages])) for n, (m, _) in made.items()}
    results = [(n, found["mae"], found["mse"], found["rmse"], found["r2"]) for n, (_, found) in made.items()]
    best = min(results, key=lambda row: row[3])[0]
    trained_at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    width = encoded.first()["features"].size
    rows = [
        (*row, row[0] == best, boundary.train_rows, boundary.test_rows, width, settings.model_version, trained_at)
        for row in results
    ]
    metrics = feature_rows.sparkSession.createDataFrame(
        rows,
        "model_name string, mae double, mse double, rmse double, r2 double, selected boolean, "
        "train_rows long, test_rows long, feature_count int, model_version string, trained_at timestamp_ntz",
    )
    return Training(fitted[best], fitted, metrics, boundary, test)


def save(training: Training, folder: str) -> None:
    """Every model, the best one once more, and the metrics."""
    for name, forecast in training.fitted.items():
        forecast.model.write().overwrite().save(f"{folder}/{name}")
    training.best.model.write().overwrite().save(f"{folder}/best_model")
    training.metrics.write.mode("overwrite").json(f"{folder}/model_metrics")


def load_best(spark: SparkSession, folder: str) -> FittedForecast:
    chosen = spark.read.json(f"{folder}/model_metrics").where("selected").first()
    return FittedForecast(chosen["model_name"], PipelineModel.load(f"{folder}/best_model"))


def evaluate_saved(
    spark: SparkSession, folder: str, feature_rows: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Metrics of the saved best model on the hold-out rows."""
    best = load_best(spark, folder)
    complete = features.model_rows(feature_rows, settings)
    training = find_boundary(complete, settings.test_size).in_training()
    scored = best.transform(complete.where(~training))
    return regression_metrics(scored, features.TARGET, PREDICTION).select(
        F.lit(best.name).alias("model_name"), "*"
    )
