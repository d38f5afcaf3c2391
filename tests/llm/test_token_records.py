import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import packing, token_records
from gridloom.llm.word_encoder import WordEncoder, default_tokenizer
from tests.conftest import SMALL
from tests.llm.samples import SCHEMA, awkward, frame, prose, with_clashing


def whole(texts):
    return [e.ids for e in Tokenizer.from_file(default_tokenizer()).encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def encoded(texts, **given):
    found = []
    for _, ids, ends in WordEncoder(default_tokenizer(), **given).encode(pa.array(texts)):
        found += [ids[ends[k] : ends[k + 1]].tolist() for k in range(len(ends) - 1)]
    return found


@pytest.mark.parametrize("remembered", [700_000, 3])
def test_words_put_together_equal_whole_texts(spark, remembered):
    texts = [r[1] or "" for r in awkward()] + [
        "It's don't WE'LL 12345 x=3.5!! (a),[b];c", "é ́x İstanbul ΣΣΣ,  wide space", "<|endoftext|> a<|startoftext|>b,",
        "naïve... co-op, 你好， мир! \U0001f600, a\u0000b \x1cc", ",,, . ;;x; 's 't'm", "ﬁ ﬁne Å ANGSTROM Å",
        "<|ENDOFTEXT|> A<|StartOfText|>B, X<|endoftext|> WORD,%%% word&&& WoRd.*** É!! 'S 'LL can'T<|", "a<|endoftext|>### b",
    ]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    assert encoded(texts, remembered=remembered) == whole(texts)


def expected(rows):
    rows = sorted(((i, t or "") for i, t, *_ in rows if i is not None), key=lambda r: r[0])
    start, found = 0, []
    for (key, _), ids in zip(rows, whole([t for _, t in rows]), strict=True):
        ids = [*ids, token_records.END_ID]
        found.append((key, len(ids), crc(ids)))
        start += len(ids)
    return found, start


def test_files_read_back(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is not None]
    df = with_clashing(frame(spark, rows)).repartition(4)
    token_records.write_records(df, str(tmp_path))
    found = sorted(token_records.read_records(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    wanted, total = expected(rows)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == sorted(wanted)
    assert [r["doc_id"] for r in found] == sorted(r[0] for r in rows)
    assert [r["start"] for r in found] == [sum(r["n_tokens"] for r in found[:k]) for k in range(len(found))]


def test_single_records_in_any_order(spark, tmp_path):
    rows = [(k, prose(k, 5 + k), None, None, None) for k in range(40)]
    index = token_records.write_records(frame(spark, rows), str(tmp_path))
    found = {r["doc_id"]: r["ids"] for r in token_records.fetch(index.orderBy(F.rand(3)), str(tmp_path), 49408).collect()}
    assert found == {k: [*ids, 1] for k, ids in enumerate(whole([r[1] for r in rows]))}


def test_damage_is_found(spark, tmp_path):
    import io

    data = token_records.frame(b"some payload")
    assert list(token_records.unframed(io.BytesIO(data * 2))) == [b"some payload"] * 2
    for at in (0, 9, 15, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_records.unframed(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(token_records.unframed(io.BytesIO(data[:-2])))


def test_empty_table_and_null_keys(spark, tmp_path):
    token_records.write_records(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert token_records.read_records(spark, str(tmp_path / "a")).isEmpty()
    with pytest.raises(Exception, match="doc_id is null"):
        token_records.write_records(frame(spark), str(tmp_path / "b"))


def test_pieces_cover_every_id_once(spark):
    rows = awkward()
    found = packing.pack(with_clashing(frame(spark)).repartition(3)).collect()
    texts = {}
    for (key, text, *_), ids in zip(rows, whole([r[1] or "" for r in rows]), strict=True):
        ids = [*ids, packing.END_ID]
        for start in range(0, len(ids), packing.LENGTH):
            part = ids[start : start + packing.LENGTH]
            texts.setdefault((key, start, len(part), crc(part), len(ids)), []).append(1)
    got = {}
    for r in found:
        got.setdefault((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]), []).append(1)
    assert got == texts


def sequences(found):
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    return by


def test_sequences_are_gapless_and_full(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    by = sequences(packing.pack(docs).collect())
    used = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
        used += at
    assert used / (len(by) * packing.LENGTH) > 0.98
    assert packing.pack(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_column_generation_is_near_the_bound():
    import numpy as np

    rng = np.random.default_rng(4)
    histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 513, 70), rng.integers(1, 4000, 70), strict=True)}
    made = packing.plan(histogram)
    size = np.array(sorted(histogram))
    room = packing.LENGTH // packing.UNIT
    _, counts = packing.column_generation(size, np.array([float(histogram[k]) for k in size]), room, 1e-9)
    assert counts.sum() - 1e-6 <= made.sequences <= counts.sum() * 1.003 + len(histogram)
    for kind, n in histogram.items():
        first, start, each, slot = made.runs[kind]
        ranks = np.arange(n)
        sequence, at = packing._placed(np.full(n, kind), ranks, made)
        assert len(set(zip(sequence.tolist(), at.tolist(), strict=True))) == n and sequence.max() < made.sequences


def test_no_plan_overfills(spark):
    import numpy as np

    histogram = {512: 3, 511: 1, 300: 7, 212: 7, 1: 900, 100: 33}
    made = packing.plan(histogram)
    filled = {}
    for kind, n in histogram.items():
        for s in packing._placed(np.full(n, kind), np.arange(n), made)[0].tolist():
            filled[s] = filled.get(s, 0) + kind
    assert max(filled.values()) <= 512
