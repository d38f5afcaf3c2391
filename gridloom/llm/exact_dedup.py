"""Operator 1: exact dedup by an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. The index is built in four steps, each a DataFrame job:

* **Entries.** Documents are grouped by (hash key, normalised text). The grouping compares the bytes of texts that share
  a key, so colliding texts become separate entries of a chain; copies are folded before the shuffle, so a text
  with a third of all rows costs one row a task.
* **Directory.** A bucket is a range of the key space, named by a prefix of ``depth`` bits. While a bucket holds more than
  ``capacity`` entries it is split by one more bit, which doubles the directory where it was the deepest. The directory is
  a table on shared files; only the number of overfull buckets reaches the driver.
* **Owners.** Every slot of the directory names its bucket. Entries are sent to the task that owns their bucket, sorted by
  key there, numbered along their collision chain, and written as the index.
* **Probe.** Each document looks up its entry by key and SHA-256 of its normalised text.

The key is 64 bits of xxHash; a weaker one may be given, and results stay the same. A bucket of one key that is too
full cannot be split and stays a long chain.

Null text: empty. Empty and very long texts: like any other. Null doc_id: kept only if no document of the
group has an id. Rows repeated with the same doc_id and text: one of them is kept. Empty table: no rows. Other columns
are ignored by the report and passed through by ``without_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.llm.common import documents, lowered, table

CAPACITY = 8192  # entries in a bucket before it splits
KEY_BITS = 64
SPARE_BITS = 4  # the histogram of keys is this much finer than evenly filled buckets need

KeyHash = Callable[[Column], Column]


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def keyed(docs: DataFrame, key: KeyHash) -> DataFrame:
    normal = documents(docs).select("doc_id", lowered(F.col("text")).alias("normal"))
    return normal.withColumn("key", key(F.col("normal")))


def entries(docs: DataFrame, key: KeyHash) -> DataFrame:
    """One row a distinct text: the keeper, the group's size, the text's digest."""
    groups = keyed(docs, key).groupBy("key", "normal").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    return groups.select("key", F.sha2("normal", 256).alias("text_sha256"), "keep_id", "group_size")


def directory(found: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Buckets (prefix, depth, entries) after all splits, and the depth of the deepest."""
    bits = max(1, math.ceil(math.log2(max(1, found.count() / capacity))) + SPARE_BITS)
    fine = stored(found.groupBy(_prefix(F.col("key"), bits).alias("fine")).agg(F.count("*").alias("n")), "key-histogram")
    buckets = fine.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), "n"
    )
    depth = 0
    while depth < bits and buckets.where(F.col("n") > capacity).count():
        overfull = buckets.where(F.col("n") > capacity)
        halves = (
            fine.withColumn("prefix", F.shiftrightunsigned("fine", bits - depth))
            .join(overfull.select("prefix"), "prefix", "left_semi")
            .groupBy(F.shiftrightunsigned("fine", bits - depth - 1).alias("prefix"))
            .agg(F.lit(depth + 1).alias("depth"), F.sum("n").alias("n"))
        )
        # A half without entries needs no row: nothing will look it up.
        buckets = stored(buckets.where(F.col("n") <= capacity).unionByName(halves), "directory")
        depth += 1
    return buckets, depth


def index(found: DataFrame, capacity: int) -> DataFrame:
    """The entries by owner: bucket, key, place in the key's collision chain."""
    buckets, depth = directory(found, capacity)
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    slots = buckets.select(
        F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)).alias("slot"),
        first.alias("bucket"),
    )
    owned = found.withColumn("slot", _prefix(F.col("key"), depth)).join(slots, "slot").repartition("bucket")
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256", "keep_id")
    return owned.select(
        "bucket", "key", F.row_number().over(chain).alias("chain"), "text_sha256", "keep_id", "group_size"
    )


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, key: KeyHash = F.xxhash64) -> DataFrame:
    """For every document its keeper and whether it is the one kept."""
    found = stored(index(stored(entries(docs, key), "entries"), capacity), "hash-index")
    probe = keyed(docs, key).select("doc_id", "key", F.sha2("normal", 256).alias("text_sha256"))
    hits = probe.join(found, ["key", "text_sha256"])
    # By doc_id alone, so that the join above stays in a stage of its own, where a hot text can be split.
    entry = F.struct("key", "text_sha256")
    before = F.lag(entry).over(Window.partitionBy("doc_id").orderBy("key", "text_sha256"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~before.eqNullSafe(entry)
    return hits.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "key")


def without_duplicates(docs: DataFrame, capacity: int = CAPACITY, key: KeyHash = F.xxhash64) -> DataFrame:
    """The kept rows with all their columns."""
    kept = stored(exact_duplicates(docs, capacity, key).where("kept").select(F.col("doc_id").alias("__id"), "text_sha256"), "kept")
    mine = docs.withColumn("__sha", F.sha2(lowered(F.coalesce(F.col("text"), F.lit(""))), 256))
    hits = mine.join(
        kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == kept["text_sha256"]), "left_semi"
    )
    repeat = F.row_number().over(Window.partitionBy("doc_id", "__sha").orderBy("text"))
    return hits.withColumn("__repeat", repeat).where("__repeat = 1").select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("key")


EXPECTED_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""
