import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import toxicity
from tests.llm.samples import SCHEMA, awkward, frame, prose, with_clashing

RUDE = ["dolt", "numbskull", "vermin", "grotzer", "grotzing", "grotzed"]


def corpus(n=700):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        words = prose(k, 40).split()
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        rows.append((k, " ".join(words), "en", f"src{k % 3}", 1))
        if k % 10:
            labels.append((k, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(*tables)


def test_lexicon_holds_the_planted_words_and_their_beginnings(model):
    assert {"w:dolt", "w:vermin", "b5:grotz"} <= set(model.terms)
    assert not any(t.startswith("w:river") or t.startswith("w:stone") for t in model.terms)


def test_held_out_documents_are_told_apart(tables, model):
    found = toxicity.scored(tables[0], model).collect()
    assert {r["held_out"] for r in found} == {True, False}
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) == int(r["doc_id"] % 4 == 0)


def test_unseen_forms_of_a_word_are_caught(spark, model):
    rows = [(1, prose(1, 30) + " grotzerei grotzlings " + prose(2, 30), None, None, None), (2, prose(3, 60), None, None, None)]
    assert [r["predicted"] for r in toxicity.scored(frame(spark, rows), model).orderBy("doc_id").collect()] == [1, 0]


def test_scores_ignore_all_but_the_text(spark, model):
    text = prose(4, 20) + " vermin dolt"
    rows = [(k, text, lang, source, n) for k, (lang, source, n) in enumerate([("en", "src0", 1), (None, None, None), ("de", "x", 9)])]
    assert toxicity.scored(with_clashing(frame(spark, rows)), model).select("score").distinct().count() == 1


def test_awkward_rows_are_scored(spark, model):
    found = toxicity.scored(with_clashing(frame(spark)), model)
    assert found.count() == len(awkward()) and found.where("score IS NULL OR predicted = 1").isEmpty()
    assert found.where("doc_id IS NULL AND held_out").isEmpty()


def test_held_out_labels_teach_nothing(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    one, other = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert one.terms == other.terms and np.allclose(one.weights, other.weights) and one.bias == pytest.approx(other.bias)


def test_without_labels_everything_stays(spark, tables):
    docs, labels = tables
    kept = toxicity.without_toxic(docs, labels.limit(0))
    assert kept.count() == docs.count() and kept.columns == docs.columns
    assert toxicity.without_toxic(docs.limit(0), labels).isEmpty()


def test_toxic_rows_go_and_clean_ones_stay(spark, tables):
    docs, labels = tables
    clash = with_clashing(docs)
    kept = toxicity.without_toxic(clash, labels)
    assert kept.columns == clash.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k in range(700) if k % 4}


def test_label_model_finds_accuracies_without_gold():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.2
    rates = np.array([(0.9, 0.02), (0.6, 0.1), (0.7, 0.01), (0.4, 0.05)] + [(0.5, 0.03)] * (toxicity.VOTERS - 4))
    votes = rng.random((20_000, toxicity.VOTERS)) < np.where(truth[:, None], rates[:, 0], rates[:, 1])
    votes[:, 5] = votes[:, 4]  # two voters that say the same
    patterns, counts = np.unique(votes @ (1 << np.arange(toxicity.VOTERS)), return_counts=True)
    none = np.zeros(len(patterns))
    start = toxicity.LabelModel(0.5, np.full(toxicity.VOTERS, 0.6), np.full(toxicity.VOTERS, 0.2), np.ones(toxicity.VOTERS))
    model = toxicity.label_model(toxicity._bits(patterns), counts.astype(float), start, (none, none))
    assert model.share == pytest.approx(0.2, abs=0.02)
    assert model.toxic[:3] == pytest.approx(rates[:3, 0], abs=0.05) and model.clean[:3] == pytest.approx(rates[:3, 1], abs=0.03)
    assert model.discount[4] == pytest.approx(0.5, abs=0.1) and model.discount[0] > 0.8


def test_sample_is_bounded(spark, tables):
    docs, labels = tables
    assert toxicity.training_rows(docs, labels, sample=100).count() < 160
    assert SCHEMA
