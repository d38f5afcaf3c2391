"""Isolation forest (Liu, Ting and Zhou, 2008) grown and applied by Spark tasks.

Each tree sees a small random sample, so trees are grown one per group; scoring is a vectorised
walk over all trees for every Arrow batch. The forest itself is at most trees x 511 nodes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.ordering import exact_median
from gridloom.functions.shared import stored
from gridloom.settings import DEFAULTS, Settings

# Model inputs, number of trees and sample per tree.
FEATURES = (
    "energy_consumption", "voltage", "current", "power_factor", "temperature", "humidity",
)
TREES = 150
SAMPLE = 256
HASH_RANGE = 1 << 31
NODE_SCHEMA = "tree int, node int, feature int, threshold double, length double"


def expected_path(count: int) -> float:
    """Average depth of an unsuccessful search among ``count`` values."""
    if count <= 1:
        return 0.0
    if count == 2:
        return 1.0
    return 2.0 * (math.log(count - 1) + np.euler_gamma) - 2.0 * (count - 1) / count


def _depth(sample: int) -> int:
    return max(1, math.ceil(math.log2(max(sample, 2))))


def grower(features: Sequence[str], depth: int, sample_size: int, seed: int):
    """A function that grows one tree; nodes are numbered like a heap, leaves have feature -1.

    It carries all it needs, so workers do not have to import this package.
    """
    unresolved = [expected_path(count) for count in range(sample_size + 1)]

    def grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        random = np.random.default_rng([seed, tree])
        values = sample.sort_values("_draw")[list(features)].to_numpy()
        nodes, waiting = [], [(0, 0, values)]
        while waiting:
            node, level, part = waiting.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if level == depth or len(part) < 2 or not len(usable):
                nodes.append((tree, node, -1, 0.0, level + unresolved[len(part)]))
                continue
            feature = int(random.choice(usable))
            threshold = random.uniform(low[feature], high[feature])
            above = part[:, feature] > threshold
            nodes.append((tree, node, feature, threshold, 0.0))
            waiting += [(2 * node + 1, level + 1, part[~above]), (2 * node + 2, level + 1, part[above])]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "length"])

    return grow


def _uniform(*parts: Column | str) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(HASH_RANGE))


def drawn_samples(
    df: DataFrame, key: Sequence[str], rows: int, trees: int, sample: int, seed: int
) -> DataFrame:
    """``min(sample, rows)`` rows per tree, chosen by hash so that reruns agree.

    Every tree draws from all rows. A row is copied only for the trees whose hash lets it pass, three
    times the needed number in expectation, so few rows move at any size; the exact choice is among those.
    """
    limit = int(min(1.0, 3.0 * sample / max(rows, 1)) * HASH_RANGE)
    passing = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: _uniform(*key, F.lit(seed), tree) < limit
    )
    best = Window.partitionBy("tree").orderBy("_draw", *key)
    return (
        df.withColumn("tree", F.explode(passing))
        .withColumn("_draw", _uniform(*key, F.lit(seed), "tree"))
        .withColumn("_place", F.row_number().over(best))
        .where(F.col("_place") <= sample)
        .drop("_place")
    )


@dataclass(frozen=True)
class IsolationForest:
    """A grown forest: node arrays of shape (trees, nodes), fill values, and its normaliser."""

    feature: np.ndarray
    threshold: np.ndarray
    length: np.ndarray
    fill: dict[str, float]
    sample: int

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        settings: Settings = DEFAULTS,
        *,
        key: Sequence[str] = ("meter_id", "timestamp"),
        trees: int = TREES,
        sample: int = SAMPLE,
    ) -> IsolationForest:
        facts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in FEATURES])
        known = facts.first()
        gaps = [c for c in FEATURES if known[c]]
        fill = _medians(df, gaps) if gaps else {}
        inputs = df.select(*key, *[_filled(c, fill).alias(c) for c in FEATURES])
        depth = _depth(min(sample, known["_rows"]))
        drawn = drawn_samples(inputs, key, known["_rows"], trees, sample, settings.seed)
        grown = drawn.select("tree", "_draw", *FEATURES).groupBy("tree").applyInPandas(
            grower(FEATURES, depth, sample, settings.seed), NODE_SCHEMA
        )
        nodes = grown.toPandas()  # at most trees * (2 ** (depth + 1) - 1) rows
        shape = (trees, 2 ** (depth + 1) - 1)
        where = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
        arrays = {}
        for name, blank in (("feature", -1), ("threshold", 0.0), ("length", 0.0)):
            arrays[name] = np.full(shape, blank, dtype=np.int64 if name == "feature" else np.float64)
            arrays[name][where] = nodes[name].to_numpy()
        return cls(**arrays, fill=fill, sample=min(sample, known["_rows"]))

    def score(self) -> Column:
        """Ten times the anomaly score, rounded to four digits; more is stranger."""
        feature, threshold, length = self.feature, self.threshold, self.length
        steps = int(math.log2(feature.shape[1] + 1)) - 1
        scale = max(expected_path(self.sample), 1e-9)

        @F.pandas_udf("double")
        def walk(*columns: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy() for c in columns])
            line, tree = np.arange(len(values))[:, None], np.arange(len(feature))[None, :]
            node = np.zeros((len(values), len(feature)), dtype=np.int64)
            for _ in range(steps):
                chosen = feature[tree, node]
                right = values[line, np.maximum(chosen, 0)] > threshold[tree, node]
                node = np.where(chosen < 0, node, 2 * node + 1 + right)
            return pd.Series(2.0 ** (-length[tree, node].mean(axis=1) / scale) * 10.0)

        return F.round(walk(*[_filled(c, self.fill) for c in FEATURES]), 4)


def _filled(column: str, fill: dict[str, float]) -> Column:
    return F.coalesce(F.col(column), F.lit(fill[column])) if column in fill else F.col(column)


def _medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    values = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (_name, _value)")
    found = exact_median(values, ["_name"], "_value", "_median").collect()  # one row per column
    return {row["_name"]: row["_median"] for row in found}


def isolation_forest_anomalies(
    df: DataFrame, settings: Settings = DEFAULTS, *, trees: int = TREES, sample: int = SAMPLE
) -> DataFrame:
    """Flag the strangest share of readings.

    Scores are computed once and kept in the shared folder. They have four digits and lie between
    0 and 10, so the exact percentile works on at most 100,001 counted values.
    """
    forest = IsolationForest.fit(df, settings, trees=trees, sample=sample)
    scored = stored(
        df.select("timestamp", "meter_id", "energy_consumption", forest.score().alias("anomaly_score")),
        "forest-scores",
    )
    counted = scored.groupBy("anomaly_score").agg(F.count(F.lit(1)).alias("_n"))
    cut = counted.agg(F.percentile("anomaly_score", F.lit(1 - settings.contamination), F.col("_n")))
    flagged = F.col("anomaly_score") > F.col("_cut")
    return scored.withColumn("_cut", cut.scalar()).select(
        "timestamp",
        "meter_id",
        "energy_consumption",
        "anomaly_score",
        flagged.cast("int").alias("anomaly_flag"),
        F.when(flagged, "abnormal_meter_behaviour").otherwise("normal").alias("anomaly_type"),
        F.lit("isolation_forest").alias("detection_method"),
    )
