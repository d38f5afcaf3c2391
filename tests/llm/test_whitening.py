import math

import numpy as np
import pytest

from gridloom.llm.whitening import jacobi_davidson, op12_whitening, whiten

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def direct(vectors):
    """Everything from the dense covariance, with exact integers where the result is exact."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    fitted = sorted({tuple(v) for v in x})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    centred = np.array(fitted, float) - np.array([s / n for s in sums])
    cover = centred.T @ centred / n
    e, u = np.linalg.eigh(cover)
    e, u = e[::-1], u[:, ::-1]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    white = (np.array(x, float) - np.array([s / n for s in sums])) @ u / np.sqrt(np.maximum(e, 1e-300))
    return n, deviation, white, e / np.trace(cover)


def agrees(got, keys, vectors, components=4):
    n, deviation, white, share = direct(vectors)
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(rows) == len(got) == len(keys) * components
    for k in range(components):
        mine = np.array([rows[key, k + 1]["whitened"] for key in keys])
        sign = np.sign(mine @ white[:, k])
        assert np.abs(mine - sign * white[:, k]).max() < 1e-8
        for at, key in enumerate(keys):
            r = rows[key, k + 1]
            assert r["n"] == n and r["deviation"] == deviation[at] and r["identity_error"] < 1e-10
            assert abs(r["explained"] / share[k] - 1) < 1e-9


def test_given_vectors_equal_the_dense_way(spark):
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    got = op12_whitening(spark, SMALL)
    assert got.columns == COLUMNS
    agrees(got.collect(), [r["vec_id"] for r in given], [r["embedding"] for r in given])


def test_unusable_rows_go_and_repeats_count_once(spark):
    rng = np.random.default_rng(1)
    good = [rng.standard_normal(6).astype(np.float32).tolist() for _ in range(40)]
    rows = [(k, v, 0) for k, v in enumerate(good)] + [(k + 40, good[3], None) for k in range(30)]
    bad = [None, [], [1.0] * 5 + [None], [math.nan] + [1.0] * 5, [math.inf] + [0.0] * 5, [1e30] * 6, [1.0] * 5, [-0.0] * 7]
    df = spark.createDataFrame(rows + [(100 + k, v, 1) for k, v in enumerate(bad)], SCHEMA)
    df = df.selectExpr("*", "'mine' AS x", "'mine' AS n", "'mine' AS component").repartition(3)
    agrees(whiten(df).collect(), list(range(70)), good + [good[3]] * 30)


def test_few_dimensions_and_no_variance(spark):
    flat = [[1.0, float(k), 2.0] for k in range(9)]
    got = whiten(spark.createDataFrame([(k, v, 0) for k, v in enumerate(flat)], SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9 and all(abs(r["explained"] - 1) < 1e-9 for r in got)
    assert whiten(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect() == []


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(k, [3.0e9 * (k % 2), float(k)], 0) for k in range(4)]
    assert {r["deviation"] for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()} == {None}


@pytest.mark.parametrize("values", [np.arange(30, 0, -1.0), np.r_[5, 5, 5, np.ones(27)], np.r_[1e6, 1e3, 1, np.full(27, 1e-3)], np.array([2.0, 1.0])])
def test_eigenpairs_reach_double_precision(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values), len(values))))
    matrix = (q * values) @ q.T
    found, vectors = jacobi_davidson(lambda v: matrix @ v, len(values), 4)
    assert np.allclose(found, values[: len(found)], rtol=0, atol=1e-13 * values[0] * 10)
    residual = np.linalg.norm(matrix @ vectors - vectors * found, axis=0)
    assert residual.max() < 2e-13 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13
