import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import weighted_sampling
from tests.llm.samples import SCHEMA, awkward, frame, prose, with_clashing


def jaccard(one, other):
    a, b = Counter(one.split()), Counter(other.split())
    both = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in both) / sum(max(a[w], b[w]) for w in both) if both else 1.0


def in_order(rows):
    known = [(-(1 << 62) if i is None else i, t or "", i) for i, t, *_ in rows]
    return sorted(known, key=lambda r: (-r[0], r[1].encode()))


def edited(rows):
    ordered = in_order(rows)
    found = []
    for k, (_, text, key) in enumerate(ordered):
        below = ordered[(k + 1) % len(ordered)][1]
        third = len(text) // 3
        made = text[: len(text) - third] + below[:third]
        found.append((str(key), len(text), hashlib.sha256(made.encode()).hexdigest(), text, made, below))
    return found


def test_edited_texts_follow_the_order(spark):
    found = weighted_sampling.fingerprints(with_clashing(frame(spark)).repartition(3), samples=8).collect()
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found)
    assert got == sorted(e[:3] for e in edited(awkward()))


@pytest.mark.parametrize("step", [1, 97, 300, 5_000_000])
def test_order_crosses_blocks_and_runs(spark, step):
    rows = [(k * step, prose(k, 3 + k % 5), None, None, None) for k in range(60)]
    random.Random(step).shuffle(rows)
    found = weighted_sampling.fingerprints(frame(spark, rows).repartition(4), samples=4).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == sorted(e[:3] for e in edited(rows))


def test_likeness_estimates_the_generalised_jaccard_similarity(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words[: 5 + k], k=80)), None, None, None) for k in range(50)]
    found = {str(r["doc_id"]): r for r in weighted_sampling.fingerprints(frame(spark, rows), samples=200).collect()}
    for key, _, _, text, made, below in edited(rows):
        assert found[key]["near_edited"] == pytest.approx(jaccard(text, made), abs=0.16)
        assert found[key]["near_next"] == pytest.approx(jaccard(text, below), abs=0.16)
    mean = sum(found[e[0]]["near_edited"] - jaccard(e[3], e[4]) for e in edited(rows)) / len(rows)
    assert abs(mean) < 0.02


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(k, "same words here" if k % 2 else f"other {k}", None, None, None) for k in range(600)]
    found = weighted_sampling.fingerprints(frame(spark, rows))
    assert found.where("doc_id % 2 = 1").select("fingerprint").distinct().count() == 1
    assert found.where("doc_id % 2 = 0").select("fingerprint").distinct().count() == 300


def test_empty_texts_one_row_and_no_row(spark):
    one = weighted_sampling.fingerprints(frame(spark, [(9, "abcdef", None, None, None)])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    both = weighted_sampling.fingerprints(frame(spark, [(1, None, None, None, None), (2, "", None, None, None), (3, "x", None, None, None)]))
    assert {r["doc_id"]: (r["fingerprint"] == "", r["near_next"]) for r in both.collect()} == {1: (True, 0.0), 2: (True, 1.0), 3: (False, 0.0)}
    assert weighted_sampling.fingerprints(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_main_path_is_native(spark):
    made = weighted_sampling.fingerprints(frame(spark), samples=2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_draws_have_the_gamma_shape(spark):
    """r and c are Gamma(2, 1): the least of many ln a for unit weights behaves like an exponential minimum."""
    words = spark.range(4000).select(F.xxhash64("id").alias("h"))
    a = words.select(F.exp(weighted_sampling.draw(F.col("h"), F.lit(0.0), 3)).alias("a"))
    share = a.where("a < 0.001").count() / 4000
    assert share < 0.02  # P(a < x) is about x for small x
    assert a.where("a <= 0 OR isnan(a)").isEmpty()
