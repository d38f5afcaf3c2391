"""Operator 3: token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames, and a frame is

    length    unsigned 64 bit   bytes of the payload
    check     unsigned 32 bit   masked CRC-32 of the 8 length bytes
    payload   doc_id (signed 64 bit), then the ids, 2 bytes each if the vocabulary allows, else 4
    check     unsigned 32 bit   masked CRC-32 of the payload

all little-endian. The mask rotates a checksum right by 15 bits and adds a constant, so that a checksum
of data that holds checksums stays useful. The layout is that of TFRecord files, with zlib's CRC-32,
because no library here computes CRC-32C at speed.

The offset index is a Parquet table beside the data (file, doc_id, byte offset, bytes, tokens): a reader
in any order fetches single frames by it. Files hold ascending ranges of doc_id. A task names its
file uniquely, and only files named in the committed index count, so retries and lost executors leave
no trace in what is read.

Null or empty text: the end id alone. Null doc_id: not a record key, rejected while writing. Repeated
doc_ids: one record each, in any order among themselves. Empty table: an empty index. Other columns are
ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.shared import fresh_path
from gridloom.llm.common import documents, table
from gridloom.llm.word_encoder import default_tokenizer, encoder

MASK_DELTA = 0xA282EAD8
END_ID = 1
INDEX = "file_no int, file string, doc_id long, position long, bytes long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(stream) -> Iterator[bytes]:
    """Payloads of a stream of frames, each checked."""
    while head := stream.read(12):
        yield _payload(head, stream)


def _payload(head: bytes, stream) -> bytes:
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError("damaged record")
    return body[:size]


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode every document into data files below ``folder`` and return the index kept beside them."""
    path = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        codec = encoder(path)
        kind = _width(max(codec.vocabulary, end_id + 1))
        number = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(f"{folder}/data")
        store.create_dir(root, recursive=True)
        name = f"part-{number:06d}-{uuid.uuid4().hex}.rec"
        at = 0
        with store.open_output_stream(f"{root}/{name}", buffer_size=1 << 20) as out:
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                for first, ids, ends in codec.encode(batch.column(1)):
                    rows = []
                    narrow = ids.astype(kind)
                    tail = np.array([end_id], kind).tobytes()
                    for k in range(len(ends) - 1):
                        key = int(keys[first + k])
                        body = struct.pack("<q", key) + narrow[ends[k] : ends[k + 1]].tobytes() + tail
                        out.write(whole := frame(body))
                        rows.append((number, name, key, at, len(whole), int(ends[k + 1] - ends[k]) + 1))
                        at += len(whole)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _index_types(), strict=True)],
                        names=[f.split()[0] for f in INDEX.split(", ")],
                    )

    keyed = documents(docs).select(F.expr("coalesce(doc_id, raise_error('doc_id is null'))").alias("doc_id"), "text")
    ordered = keyed.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _index_types() -> list[pa.DataType]:
    return [pa.int32(), pa.string(), *[pa.int64()] * 4]


def read_records(spark: SparkSession, folder: str, tokenizer_vocabulary: int | None = None) -> DataFrame:
    """Per record, from the files: position in the corpus, length and checksum of its ids.

    Each task reads whole files frame by frame, so its memory is one frame's; sums per file, not
    records, are put in order to find where a file starts.
    """
    kind = _width(tokenizer_vocabulary or encoder(default_tokenizer()).vocabulary)
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files = index.groupBy("file_no", "file").agg(F.sum("n_tokens").alias("tokens"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(f"{folder}/data")
        for batch in batches:
            for name, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, before, lengths, sums = [], [], [], []
                with store.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as stream:
                    for body in unframed(stream):
                        ids = np.frombuffer(body, kind, offset=8)
                        keys.append(struct.unpack_from("<q", body)[0])
                        before.append(total)
                        lengths.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        total += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (keys, before, lengths, sums)],
                    names=[f.split()[0] for f in RESULT.split(", ")],
                )

    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    # A number of its own: sizes of file names must not decide how few tasks read the files.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(tasks, "file").mapInArrow(read, RESULT)


def fetch(index_rows: DataFrame, folder: str, vocabulary: int) -> DataFrame:
    """Records named by rows of the index, in the order of the rows: the reader of shuffled training."""
    kind = _width(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(f"{folder}/data")
        for batch in batches:
            keys, found = [], []
            for name, position in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as stream:
                    stream.seek(position)
                    body = next(unframed(stream))
                keys.append(struct.unpack_from("<q", body)[0])
                found.append(np.frombuffer(body, kind, offset=8).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"]
            )

    return index_rows.select("file", "position").mapInArrow(read, "doc_id long, ids array<long>")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-records")
    write_records(table(spark, sf_dir, "documents"), folder)
    return read_records(spark, folder)
