import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import jaccard_join
from gridloom.llm.components import components
from tests.llm.samples import SCHEMA, WORDS, awkward, frame, with_clashing

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def brute(rows, percent=75):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(b)] = find(a)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    lowest = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return sorted(((rows[k][0], len(sets[k]), lowest[find(k)]) for k in range(len(rows))), key=str)


def compared(df, rows, **given):
    found = jaccard_join.near_duplicates(df, **given).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_awkward_rows(spark):
    compared(with_clashing(frame(spark)), awkward())


def varied(seed, families=12, members=14, noise=40):
    """Families of edited copies, some chained, beside texts that share a long passage only."""
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(400))
    passage = [word() for _ in range(30)]
    rows, key = [], 0
    for _ in range(families):
        text = [word() for _ in range(rng.randrange(6, 90))]
        for _ in range(members):
            if rng.random() < 0.3:  # a chain: the next copies start from this one
                text = list(text)
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(copy) // 14)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                text = copy
            rows.append((key := key + 1, " ".join(copy), None, None, None))
    for k in range(noise):
        own = [word() for _ in range(rng.randrange(2, 60))]
        rows.append((key := key + 1, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]), None, None, None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, stars, chunk", [(1, 2, 10 << 20), (2, 1, 4000), (3, 2, 2000)])
def test_families_and_a_shared_passage(spark, monkeypatch, seed, stars, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", chunk)
    rows = varied(seed)
    compared(frame(spark, rows).repartition(5), rows, stars=stars)


def test_a_link_that_no_pivot_sees(spark):
    """Without stars the last step alone must find everything."""
    rows = varied(7, families=5, members=6, noise=10)
    found = jaccard_join.near_duplicates(frame(spark, rows), stars=1)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    df = with_clashing(frame(spark))
    kept = jaccard_join.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, 9, 10, 11, 12, 12, None], key=str)


def test_rows_without_or_with_the_same_doc_id_keep_their_own_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", 500)
    text = lambda name, n=30: " ".join(f"{name}{k}" for k in range(n))
    near = text("a") + " end"
    rows = [
        (None, text("b")), (None, text("c")), (None, text("d")), (None, text("d") + " end"),  # d: one of two near copies
        (None, text("a")), (7, near),  # a row with a doc_id stands for the component
        (9, text("e")), (9, text("f")), (9, text("f")), (8, text("e") + " end"),
        (None, ""), (None, " "), (None, None), (3, "\x0b\x0c"), (None, ""),
    ]
    df = frame(spark, [(*r, None, None, None) for r in rows]).repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each_group(df).collect()]
    of_d = [r for r in kept if r[1] and r[1].startswith("d0 ")]
    assert len(of_d) == 1 and of_d[0] in rows
    kept.remove(of_d[0])
    wanted = [rows[0], rows[1], (7, near), (8, text("e") + " end"), (9, text("f")), *rows[10:]]
    assert sorted(kept, key=str) == sorted(wanted, key=str)
    found = jaccard_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_a_third_of_all_rows_alike(spark):
    text = " ".join(f"w{k}" for k in range(40))
    hot = spark.range(1500).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, text).otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"v{k}x"), F.col("id")) for k in range(8)])).alias("text")
    )
    found = jaccard_join.near_duplicates(hot)
    sizes = sorted(r["count"] for r in found.groupBy("component_id").count().collect())
    assert sizes == [1] * 1000 + [500]


def test_many_near_copies_about_the_threshold(spark):
    """Two thousand edited copies, most pairs just below the threshold and many just above, without rounds in between."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(2000):
        words = list(base)
        for at in rng.choice(120, rng.integers(1, 4), replace=False):
            words[at] = f"x{rng.integers(3)}y{at}"
        rows.append((k, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    place = {s: n for n, s in enumerate({s for one in sets for s in one})}
    matrix = np.zeros((len(rows), len(place)), np.float32)
    for k, one in enumerate(sets):
        matrix[k, [place[s] for s in one]] = 1
    shared, sizes = matrix @ matrix.T, matrix.sum(axis=1)
    linked = 100 * shared >= 75 * (sizes[:, None] + sizes - shared)
    assert 0.2 < linked.mean() < 0.9
    root, fresh = np.arange(len(rows)), True
    while fresh:
        lower = np.array([root[linked[k]].min() for k in range(len(rows))])
        fresh, root = bool((lower != root).any()), lower
    found = jaccard_join.near_duplicates(frame(spark, [(*r, None, None, None) for r in rows]).repartition(4), turns=0)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(root.tolist()))


def test_bitmaps_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(2)
    for n in (1, 5, 100, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for edits in (0, 1, n // 7, n):
            b = np.unique(np.concatenate([a[edits:], rng.integers(0, 1 << 63, edits, np.uint64)]))
            x, y = (jaccard_join.parity_bits(s) for s in (a, b))
            bits = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
            assert bits <= len(np.setxor1d(a, b)) and (edits or bits == 0)


def test_empty_table(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_shingle_sets_by_hand():
    texts = ["a b c d e f", "A B C D E F", "x", "", " a  b c d e", "a b c d e f a b c d e f"]
    sets = [set(s.tolist()) for s in jaccard_join.shingle_sets(pa.array(texts))]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[0] == sets[1] and sets[4] < sets[0] < sets[5]


def test_planes_return_every_difference():
    tokens = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 1000, np.uint64))
    data = jaccard_join._planes(np.diff(tokens, prepend=np.uint64(0)), jaccard_join.PLANES)
    assert (np.cumsum(jaccard_join._unplaned(data, jaccard_join.PLANES)) == tokens).all()


def test_components_of_a_path_a_star_and_a_loop(spark):
    path = [(f"a{k:03d}", f"a{k + 1:03d}") for k in range(60)]
    star = [("b000", f"b{k:03d}") for k in range(1, 300)]
    edges = spark.createDataFrame([*path, *star, ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("d", "d")], "u string, v string")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {n: n[0] + {"a": "000", "b": "000", "c": "1"}[n[0]] for e in [*path, *star] for n in e} | {f"c{k}": "c1" for k in (1, 2, 3)}
