import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridloom.functions.ordering import exact_median, running_total


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_row_number_over_a_total_order(spark, parts):
    rng = random.Random(parts)
    rows = [(i, float(rng.choice([0, 0, 0, 5, rng.random()]))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(parts)
    ranked = running_total(df, [-F.col("v"), F.col("id")], "rn")
    found = [r["id"] for r in ranked.orderBy("rn").collect()]
    assert found == [i for i, v in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r["rn"] for r in ranked.collect()) == list(range(1, 401))


def test_weighted_within_groups_with_one_heavy_and_one_missing_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else None, i, rng.randrange(1, 9)) for i in range(300)] + [("tiny", 1000, 4)]
    df = spark.createDataFrame(rows, "g string, k long, w long")
    found = {
        (r["g"], r["k"]): r["upto"]
        for r in running_total(df, [F.col("k")], "upto", within=["g"], weight=F.col("w")).collect()
    }
    for group in ("hot", None, "tiny"):
        sofar = 0
        for _, k, w in sorted(r for r in rows if r[0] == group) if group else sorted(
            (r for r in rows if r[0] is None), key=lambda r: r[1]
        ):
            sofar += w
            assert found[(group, k)] == sofar


@pytest.mark.parametrize("size", [1, 2, 9, 200])
def test_exact_median(spark, size):
    rng = random.Random(size)
    values = {name: [round(rng.choice([1.0, rng.random() * 9]), 2) for _ in range(size)] for name in "ab"}
    rows = [(name, v) for name, vs in values.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "name string, v double")
    found = {r["name"]: r["m"] for r in exact_median(df, ["name"], "v", "m").collect()}
    assert found == pytest.approx({name: statistics.median(vs) for name, vs in values.items()})


@pytest.mark.parametrize("splits", [16, 4096])
def test_exact_median_of_large_groups_by_narrowing(spark, splits):
    """Groups far beyond what a task may order: ties, one value, tiny and huge numbers, and a hot group."""
    rng = random.Random(splits)
    groups = {
        "hot": [round(rng.gauss(3, 1), 2) for _ in range(900)],
        "alike": [7.25] * 300,
        "two": [1.0] * 50 + [2.0] * 50,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-3, 3) for _ in range(61)],
        "close": [1.0 + k * 2.0**-52 for k in range(40)],
        "edge": [-1.7e308, 1.7e308] * 10,
        "small": [5.0, 1.0, 9.0],
        None: [float(k * k) for k in range(30)],
    }
    rows = [(name, v) for name, values in groups.items() for v in values] + [("hot", None), ("nothing", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, v double").repartition(3)
    found = {r["name"]: r["m"] for r in exact_median(df, ["name"], "v", "m", largest=8, splits=splits).collect()}
    assert found == {name: statistics.median(values) for name, values in groups.items()}


def test_medians_neither_sort_ranges_nor_sample(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, v double")
    plan = exact_median(df, ["name"], "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan
