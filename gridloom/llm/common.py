"""What the corpus operators share: reading a table and small column expressions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # of rows that go to a Python worker at once
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what was freed unless told otherwise
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system: the worker lives on, idle beside other stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def released(made: pa.Table) -> pa.Table:
    """The same table; what was freed while it was made goes back."""
    give_back()
    return made


def freeing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on a task's batches, with a worker's freed memory given back behind the last."""

    def worked(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return worked


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, ``text`` (null counts as empty) and the columns in ``keep``, whatever else there is.

    Texts are long: batches for Python are bounded by bytes here, as 10,000 rows can be any size.
    """
    docs.sparkSession.conf.set(BATCHES, str(BATCH_BYTES))
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select("doc_id", text, *keep)


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; the fast way where a text is all ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
