import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup
from tests.llm.samples import SCHEMA, awkward, frame, with_clashing

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(LOW), []).append(r[0])
    found = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            found.append((i, keep, len(ids), kept, digest))
    return sorted(found, key=str)


@pytest.mark.parametrize(
    "capacity, key",
    [(8192, F.xxhash64), (2, F.xxhash64), (1, lambda t: F.length(t).cast("long")), (3, lambda t: F.shiftleft(F.xxhash64(t), 62))],
)
def test_any_hash_and_capacity_give_the_same_groups(spark, capacity, key):
    df = with_clashing(frame(spark))
    found = exact_dedup.exact_duplicates(df, capacity, key).drop("key")
    assert sorted(map(tuple, found.collect()), key=str) == brute(awkward())


def test_buckets_hold_no_more_than_their_capacity(spark):
    found = exact_dedup.entries(spark.range(500).select("id", F.col("id").cast("string").alias("text")).withColumnRenamed("id", "doc_id"), F.xxhash64)
    buckets, depth = exact_dedup.directory(found, 20)
    rows = buckets.collect()
    assert sum(r["n"] for r in rows) == 500 and max(r["n"] for r in rows) <= 20
    assert depth == max(r["depth"] for r in rows) >= 5


def test_colliding_texts_are_one_chain(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id long, text string")
    index = exact_dedup.index(exact_dedup.entries(df, lambda t: F.lit(7).cast("long")), 2)
    assert sorted(r["chain"] for r in index.collect()) == [1, 2, 3, 4, 5, 6]


def test_rows_kept_keep_their_columns(spark):
    df = with_clashing(frame(spark))
    kept = exact_dedup.without_duplicates(df)
    assert kept.columns == df.columns
    wanted = sorted((i for i, _, _, k, _ in brute(awkward()) if k), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == wanted
    assert kept.where("doc_id = 2").first()["text"].isupper()


def test_a_hot_text_and_an_empty_table(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "Same").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.exact_duplicates(hot)
    assert found.where("kept").count() == 1001 and found.agg(F.max("group_size")).first()[0] == 2000
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert exact_dedup.without_duplicates(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_main_path_is_native(spark):
    plan = exact_dedup.exact_duplicates(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
