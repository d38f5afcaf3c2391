import zlib

import pyarrow as pa
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from gridloom.llm import common, packing
from tests.conftest import SMALL
from tests.llm.samples import SCHEMA, frame, prose
from tests.llm.test_jaccard_join import brute
from tests.llm.test_toxicity import corpus

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic rows, copies with other capitals, near copies and clean rows with labels."""
    rows, labels = corpus(400)
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + r[0], r[1].upper(), *r[2:]) for r in clean[:60]]
    for r in clean[60:120]:
        words = r[1].split()
        words[-1] = "altered"
        rows.append((2000 + r[0], " ".join(words), *r[2:]))
    rows += [(5000, None, None, None, None), (5001, "", "en", "src1", 0)]
    at = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def test_workers_give_freed_memory_back(monkeypatch):
    """At the end of a task's batches, behind a group, and behind each batch of encoded texts."""
    given = []
    monkeypatch.setattr(common, "_trim", given.append)
    assert list(common.freeing(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and given == [0]
    assert common.released(made := pa.table({"a": [1]})) is made and given == [0, 0]
    assert list(packing.encoder(packing.default_tokenizer()).encode(pa.array(["some words"]))) and given == [0, 0, 0]


def test_stages_decide_as_their_operators(spark, folder, tmp_path):
    at, rows = folder
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
    left = [r for r in rows if not (r[0] < 1000 and r[0] % 4 == 0)]
    assert kept["toxicity"] == sorted(r[0] for r in left)
    last = {}
    for r in sorted(left, key=lambda r: r[0]):
        last[(r[1] or "").translate(LOW)] = r
    assert kept["exact dedup"] == sorted(r[0] for r in last.values())
    groups = brute(sorted(last.values(), key=lambda r: r[0]))
    assert kept["near dedup"] == sorted({g[2] for g in groups})
    assert set(kept["mixing"]) <= set(kept["near dedup"])


def test_run_packs_what_the_stages_left(spark, folder):
    found = corpus_pipeline.run(spark, folder[0]).collect()
    assert found and all(r["doc_id"] >= 1000 or r["doc_id"] % 4 for r in found)
    used = {}
    for r in found:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= packing.LENGTH
    assert zlib.crc32(b"") == 0 and prose(1, 2)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


@pytest.mark.parametrize("name", [n for n in registry.queries() if n.startswith("op")])
def test_registered_queries_run_on_the_given_tables(spark, name):
    found = registry.queries()[name](spark, SMALL)
    table = {"op7_html_text": "pages", "op10_chat": "conversations"}.get(name, "documents")
    rows = found.count()
    assert rows > 0
    if name in ("op1_exact_dedup", "op2_pii", "op3_token_records", "op5_toxicity", "op6_fingerprints", "op7_html_text", "op8_jaccard_join"):
        assert rows == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
