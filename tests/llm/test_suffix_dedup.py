import hashlib
import random

import numpy as np
import pytest

from gridloom.llm import suffix_dedup
from gridloom.llm.suffix_dedup import op11_suffix_dedup, repeated_spans
from tests.llm.samples import awkward, frame, prose, with_clashing

SMALL = "/root/testdata/sf0.001"


def brute(rows, span=50):
    """Every span of every text against the smallest doc_id that has it."""
    last = 1 << 70
    keyed = [(last if k is None else k, (t or "").encode()) for k, t in rows]
    least = {}
    for k, text in keyed:
        for i in range(len(text) - span + 1):
            piece = text[i : i + span]
            least[piece] = min(k, least.get(piece, last))
    found = []
    for (name, _), (k, text) in zip(rows, keyed, strict=True):
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - span + 1):
            if least[text[i : i + span]] < k:
                gone[i : i + span] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        found.append((name, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def planted(seed=0, n=120):
    """Texts that share passages around the span's length, at their ends and across each other."""
    rng = random.Random(seed)
    passages = [prose(100 + k, 12)[: 47 + k] for k in range(8)] + ["é" * 30, "ab" * 60, "x" * 200]
    rows = []
    for k in range(n):
        parts = [prose(1000 + k, rng.randrange(1, 20)) for _ in range(2)]
        parts += [p[rng.randrange(0, 3) :] if k % 2 else p for p in rng.sample(passages, 2)]
        rng.shuffle(parts)
        rows.append((k * 7 % n, "".join(parts)))
    return rows


@pytest.mark.parametrize(("chunk", "hot", "most"), [(8 << 20, 20_000, 64), (3_000, 20_000, 3), (5_000, 4, 64)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, chunk, hot, most):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rows = planted() + [(k, t) for k, t, *_ in awkward() if t is None or len(t) < 5_000]
    rows += [(None, rows[0][1]), (None, "no number " * 9), (None, "no number " * 9), (3, "no number " * 9), (3, "same id " * 20), (3, "same id " * 20 + "!")]
    df = with_clashing(frame(spark, [(k, t, None, None, None) for k, t in rows])).repartition(5)
    assert sorted((tuple(r) for r in repeated_spans(df).collect()), key=str) == brute(rows)


def test_given_documents_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_suffix_dedup(spark, SMALL)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_no_documents_no_rows(spark):
    assert repeated_spans(frame(spark, [])).collect() == []


def test_suffixes_are_sorted_by_their_span():
    data = np.frombuffer((b"ab" * 40 + b"abc" * 30 + prose(1, 400).encode()) * 2, np.uint8)
    suffixes = np.arange(len(data) - 49)
    sorter = suffix_dedup.SuffixSort(data, 50, 1)
    ordered = sorter.order(suffixes)
    spelt = [data[k : k + 50].tobytes() for k in ordered]
    assert sorted(ordered.tolist()) == suffixes.tolist() and spelt == sorted(spelt)
    begins = sorter.classes(ordered)
    assert begins.tolist() == [k for k in range(len(spelt)) if not k or spelt[k] != spelt[k - 1]]


def test_equal_hashes_of_different_bytes_are_noticed(monkeypatch):
    """With hashes that call everything equal the first sorts are refused; others follow until one is right."""
    texts = [prose(1, 20).encode(), prose(2, 20).encode(), prose(1, 20).encode()[5:]]
    firsts = np.array([5, 3, 9])
    want = [x.tolist() for x in suffix_dedup.least_firsts(texts, firsts, 50)]
    true, seeds = suffix_dedup.PrefixHashes, []

    class Weak(true):
        def __init__(self, data, seed=0):
            super().__init__(data, seed)
            seeds.append(seed)
            if seed < 3:
                self._sums[:] = 0

    monkeypatch.setattr(suffix_dedup, "PrefixHashes", Weak)
    assert [x.tolist() for x in suffix_dedup.least_firsts(texts, firsts, 50)] == want
    assert seeds == [1, 2, 3]
