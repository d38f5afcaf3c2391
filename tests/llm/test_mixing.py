import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing
from tests.llm.samples import SCHEMA, awkward, frame, with_clashing


def test_equals_sql_on_awkward_rows(spark):
    con = duckdb.connect()
    docs = frame(spark).toPandas()
    docs["doc_id"], docs["n_chars"] = docs["doc_id"].astype("Int64"), docs["n_chars"].astype("Int64")
    con.register("documents", docs)
    wanted = con.execute(mixing.expected_sql()).fetchall()
    found = mixing.mixed(frame(spark))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "mix_key"]


def test_order_is_the_global_shuffle(spark):
    keys = [r["mix_key"] for r in mixing.mixed(frame(spark).repartition(3)).collect()]
    assert keys == sorted(keys)
    again = [r["mix_key"] for r in mixing.mixed(frame(spark).repartition(1)).collect()]
    assert keys == again


def test_shares_come_out_as_wanted(spark):
    docs = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 30 == 1, "small").otherwise("else").alias("source")
    )
    got = {r["source"]: r["count"] for r in mixing.mixed(docs, {"big": 1, "small": 2}, other=1).groupBy("source").count().collect()}
    for source, share in (("big", 0.25), ("small", 0.5), ("else", 0.25)):
        assert abs(got[source] - share * 60_000) < 5 * math.sqrt(share * 60_000 * 20)


def test_inverse_of_the_distribution():
    for rate in (0.05, 1.0, 7.5, 150.0):
        steps = mixing.cumulative(rate)
        assert steps == sorted(steps) and steps[-1] == pytest.approx(1)
        mean = sum(1 - s for s in steps)
        assert mean == pytest.approx(rate, rel=1e-6)


def test_empty_tables_clashes_and_excess(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).isEmpty()
    clash = with_clashing(frame(spark))
    assert mixing.mixed(clash).columns == clash.columns
    assert awkward()
    assert mixing.rates({"a": 1, "b": 100_000}, {"a": 1.0, "b": 1.0}, 1.0, 100_000) == {"a": 50_000.0, "b": 0.5}


def against_sql(spark, rows):
    con = duckdb.connect()
    docs = frame(spark, rows).toPandas()
    docs["doc_id"], docs["n_chars"] = docs["doc_id"].astype("Int64"), docs["n_chars"].astype("Int64")
    con.register("documents", docs)
    wanted = con.execute(mixing.expected_sql()).fetchall()
    found = list(map(tuple, mixing.mixed(frame(spark, rows)).collect()))
    assert sorted(map(str, found)) == sorted(map(str, wanted))
    return found


def test_one_row_without_a_source_among_ten_thousand(spark):
    rows = [(k, "x", "en", f"src{k % 20}", 1) for k in range(10_000)] + [(10_000, "lone", "en", None, 4)]
    lone = sum(r[3] is None for r in against_sql(spark, rows))
    assert abs(lone - 10_001 / 21) < 5 * math.sqrt(10_001 / 21)


def test_a_source_of_three_rows(spark):
    rows = [(k, "x", "en", "src19" if k < 3 else f"src{k % 19}", 1) for k in range(20_000)]
    few = sum(r[3] == "src19" for r in against_sql(spark, rows))
    assert abs(few - 1000) < 5 * math.sqrt(1000)


def test_rates_of_any_height_keep_mean_and_spread(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("a").alias("source"))
    found = mixing.mixed(docs, {"a": 1.0}, epochs=5000.0).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m")
    )
    sizes = [(r["n"], r["d"], r["m"]) for r in found.collect()]
    assert len(sizes) == 400 and all(n == d == m + 1 for n, d, m in sizes)
    mean = sum(n for n, _, _ in sizes) / 400
    spread = sum((n - mean) ** 2 for n, _, _ in sizes) / 399
    assert abs(mean - 5000) < 5 * math.sqrt(5000 / 400) and 0.6 < spread / 5000 < 1.5
