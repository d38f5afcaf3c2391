import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor as SparkForest
from pyspark.sql import functions as F

from gridloom.operators import forest

WIDTHS = (32, 5, 2, 1)


def table(size, seed=1):
    """Bins of four features, the last one constant, and a target that hangs on the first two."""
    random = np.random.default_rng(seed)
    bins = np.column_stack([random.integers(0, w, size) for w in WIDTHS]).astype(np.uint8)
    return bins, np.round(bins[:, 0] * 0.5 + (bins[:, 1] == 3) * 7 + random.normal(0, 1, size), 4)


def layout():
    return forest.Layout([np.arange(w - 1) for w in WIDTHS])


def plainly_grown(bins, target, weight, node, levels, leaf):
    """All nodes by trying every cut with the plain sum of squares."""

    def squares(rows):
        w, y = weight[rows].astype(float), target[rows]
        return (w * (y - np.average(y, weights=w)) ** 2).sum()

    rows = np.arange(len(bins))
    made, waiting = {}, [(node, levels, rows)]
    while waiting:
        node, left, rows = waiting.pop()
        cuts = []
        for feature in range(bins.shape[1]) if left else ():
            for cut in range(WIDTHS[feature] - 1):
                below = bins[rows, feature] <= cut
                parts = rows[below], rows[~below]
                if min(weight[p].sum() for p in parts) >= leaf:
                    cuts.append((squares(parts[0]) + squares(parts[1]), feature, cut, parts))
        best = min(cuts, key=lambda c: c[0], default=None)
        value = np.average(target[rows], weights=weight[rows])
        if best is None or squares(rows) - best[0] <= 1e-9 * squares(rows):
            made[node] = (-1, value)
            continue
        made[node] = (best[1], value)
        waiting += [(2 * node, left - 1, best[3][0]), (2 * node + 1, left - 1, best[3][1])]
    return made


@pytest.mark.parametrize(("size", "levels", "leaf"), [(1, 3, 2), (40, 18, 2), (300, 18, 1), (300, 4, 5)])
def test_a_tree_is_the_one_that_trying_every_cut_gives(size, levels, leaf):
    bins, target = table(size)
    weight = np.random.default_rng(2).integers(1, 4, size)
    grown = forest.grow(layout(), bins, target, weight, 1, levels, leaf)
    wanted = plainly_grown(bins, target, weight, 1, levels, leaf)
    assert {int(n): int(f) for n, f in zip(grown.node, grown.feature, strict=True)} == {n: f for n, (f, _) in wanted.items()}
    assert np.allclose(grown.value, [wanted[int(n)][1] for n in grown.node])


def test_equal_targets_are_not_cut():
    bins, _ = table(50)
    assert len(forest.grow(layout(), bins, np.full(50, 0.1), np.ones(50, int), 1, 18, 2).node) == 1


def test_draws_are_poisson_and_differ_by_tree_and_seed():
    ids = np.concatenate([np.arange(50_000), np.arange(50_000) + (1 << 33)])
    drawn = [forest.draws(ids, tree, seed) for tree, seed in ((0, 42), (1, 42), (0, 43))]
    for d in drawn:
        assert abs(d.mean() - 1) < 0.02 and abs(d.var() - 1) < 0.03 and abs((d == 0).mean() - np.exp(-1)) < 0.01
    assert all(abs(np.corrcoef(drawn[0], d)[0, 1]) < 0.02 for d in drawn[1:])
    assert (forest.draws(ids, 0, 42) == drawn[0]).all()


@pytest.fixture(scope="module")
def rows(spark):
    bins, target = table(1500)
    columns = [(*map(float, b), float(y)) for b, y in zip(bins, target, strict=True)]
    df = spark.createDataFrame(columns, "a double, b double, c double, d double, label double").repartition(3)
    noisy = F.col("a") + F.rand(7) / 2  # more values than bins
    return df.select("label", array_to_vector(F.array(noisy, "b", "c", "d")).alias("features")).localCheckpoint()


def estimator(kind=forest.RandomForestRegressor, trees=12):
    return kind(numTrees=trees, maxDepth=9, minInstancesPerNode=2, featureSubsetStrategy="all", seed=42)


def nodes(model):
    return {
        t["tree"]: (np.frombuffer(t["feature"], np.int16).tolist(), bytes(t["cut"]), np.frombuffer(t["value"]).round(9).tolist())
        for t in model.trees().collect()
    }


def error(model, df):
    return model.transform(df).agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2))).first()[0]


def test_as_good_as_sparks_forest(rows):
    """Other draws of the same method: errors agree to a few percent."""
    own, theirs = (error(estimator(kind, 30).fit(rows), rows) for kind in (forest.RandomForestRegressor, SparkForest))
    assert own == pytest.approx(theirs, rel=0.05)


def test_large_nodes_counted_by_all_tasks_give_the_same_trees(rows, monkeypatch):
    """Once whole trees grow in one task each, once only nodes of up to 100 rows do."""
    whole = estimator().fit(rows)
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 100)
    split = estimator().fit(rows)
    assert len(nodes(whole)) == 12 and nodes(whole) == nodes(split)
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 0)
    assert nodes(estimator().fit(rows)) == nodes(whole)


def test_few_values_are_cut_in_the_middle_and_many_at_quantiles(spark):
    df = spark.range(0, 6400, 1, 3).select(F.array(F.col("id") % 3 * 2.0, F.col("id").cast("double"), F.lit(5.0)).alias("x"))
    few, many, none = forest.cut_points(df, 32)
    assert few.tolist() == [1.0, 3.0] and not len(none)
    assert len(many) == 31 and np.abs(many - np.arange(200, 6400, 200)).max() <= 10


def test_a_saved_forest_answers_alike(rows, tmp_path):
    fitted = PipelineModel([estimator().fit(rows)])
    fitted.write().overwrite().save(str(tmp_path / "forest"))
    loaded = PipelineModel.load(str(tmp_path / "forest"))
    made = [sorted(tuple(r) for r in m.transform(rows).select("label", "prediction").collect()) for m in (fitted, loaded)]
    assert made[0] == made[1] and loaded.stages[0].uid == fitted.stages[0].uid


def test_odd_rows(spark, rows):
    one = rows.limit(1).localCheckpoint()
    assert estimator().fit(one).transform(one).where("prediction = label").count() == 1
    assert estimator().fit(rows).transform(rows.where("label IS NULL")).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        estimator().fit(rows.limit(0))
    with pytest.raises(Exception, match="label is missing"):
        estimator().fit(rows.withColumn("label", F.lit(None).cast("double"))).trees().collect()
    with pytest.raises(ValueError, match="featureSubsetStrategy"):
        forest.RandomForestRegressor(featureSubsetStrategy="sqrt").fit(rows)


def test_deep_trees_of_many_rows_stay_small(spark):
    """Every row may end in a leaf of its own, and still no histogram of such a node leaves its task."""
    df = spark.range(0, 20_000, 1, 4).select(
        F.rand(3).alias("label"), array_to_vector(F.array(*[F.rand(k) for k in range(10, 16)])).alias("features")
    )
    model = forest.RandomForestRegressor(numTrees=4, maxDepth=18, minInstancesPerNode=2, featureSubsetStrategy="all", seed=1).fit(df)
    sizes = model.trees().select(F.length("cut").alias("n")).collect()
    assert len(sizes) == 4 and all(5_000 < r["n"] < 26_000 for r in sizes)
