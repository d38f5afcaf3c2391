"""Operator 6: document fingerprints by consistent weighted sampling.

A text is a weighted set: its words with their counts. For each of ``SAMPLES`` draws, a word has numbers hashed from it alone: r and c
with a Gamma(2, 1) distribution and b uniform. A word of weight w proposes ``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t - b + 1)``;
the word with the least a is the sample. Two texts draw the same (word, t) with a chance equal to their
generalised Jaccard similarity. As a is a continuous number made from (word, t) alone, its bits stand for the
pair, so a signature is the least ``ln a`` of each draw and needs nothing but minima of doubles: one hash aggregation
with fixed-width buffers.

Documents are put in descending order of doc_id by blocks of 256 ids. A block is sorted in the task that has
it; the row after its last is the first row of the next block that has any. First rows are found before the shuffle, and
blocks are ordered within runs of 4096, then the runs among themselves, so no task sees more than one number per million ids.
The text is shuffled once; counting words and drawing samples stay within a block's task.

Null or empty text, or white space alone: no samples, an empty fingerprint; alike (1) to another such text, not at all to others.
Null doc_id: behind all others. Ties and repeated rows: by text. One document: it follows itself. Empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.llm.common import documents, table

SAMPLES = 32
BLOCK_BITS = 8  # a block has the rows of 256 ids
RUN_BITS = 12  # a run has 4096 blocks
SPLITS = 4  # partitions of the text for each shuffle partition of the session: keeps the word counts of a task in memory
LOWEST = -(1 << 62)
FACTS = 2  # in place of a side: a row about the document itself
SPACE = r"[\x20\x09-\x0D]+"


def _uniform(hashed: Column, low: int, bits: int) -> Column:
    """A number inside (0, 1) from some bits of a hash."""
    taken = F.shiftrightunsigned(hashed, low).bitwiseAND(F.lit((1 << bits) - 1))
    return (taken.cast("double") + 0.5) / float(1 << bits)


def draw(word_hash: Column, log_weight: Column, k: int) -> Column:
    """``ln a`` of draw k for a word of the given weight."""
    x, y = F.xxhash64(word_hash, F.lit(2 * k)), F.xxhash64(word_hash, F.lit(2 * k + 1))
    r = -F.log(_uniform(x, 0, 21) * _uniform(x, 21, 21))
    log_c = F.log(-F.log(_uniform(x, 42, 21) * _uniform(y, 0, 21)))
    b = _uniform(y, 21, 32)
    return log_c - r * (F.floor(log_weight / r + b).cast("double") - b + 1)


def _ordered(docs: DataFrame) -> DataFrame:
    block = F.shiftright(F.coalesce("doc_id", F.lit(LOWEST)), BLOCK_BITS)
    return documents(docs).withColumn("block", block)


def _order() -> WindowSpec:
    """Descending doc_id within a block, null last, ties by text."""
    return Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), "text")


def _after(blocks: DataFrame) -> DataFrame:
    """For each block the next lower one that has rows; for the lowest the highest."""
    runs = blocks.select("block", F.shiftright("block", RUN_BITS).alias("run"))
    within = runs.withColumn("lower", F.lead("block").over(Window.partitionBy("run").orderBy(F.desc("block"))))
    down = Window.orderBy(F.desc("run"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = runs.groupBy("run").agg(F.max("block").alias("top"))
    tops = tops.select("run", F.coalesce(F.lead("top").over(down), F.max("top").over(whole)).alias("below"))
    return within.join(tops, "run").select("block", F.coalesce("lower", "below").alias("after"))


def _followed(docs: DataFrame, firsts: DataFrame, partitions: int) -> DataFrame:
    """Every row with its number in its block, its follower's place, its own text and the edited one."""
    rows = _ordered(docs).repartition(partitions, "block")
    order = _order()
    rows = rows.select(
        "*", F.row_number().over(order).alias("number"), F.lead("text").over(order).alias("below")
    ).join(firsts, "block")
    third = F.expr("cast(length(text) div 3 as int)")
    inside = F.col("below").isNotNull()
    kept = F.substring("text", F.lit(1), F.length("text") - third)
    return rows.select(
        "doc_id", "block", "number", "text",
        F.when(inside, F.col("block")).otherwise(F.col("after")).alias("next_block"),
        F.when(inside, F.col("number") + 1).otherwise(1).alias("next_number"),
        F.concat(kept, F.substring(F.coalesce("below", "after_text"), F.lit(1), third)).alias("edited"),
    )


def _signatures(rows: DataFrame, samples: int) -> DataFrame:
    """The draws of both texts of each row, counted and drawn where the row already is."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))
    both = rows.select("block", "number", F.explode(sides).alias("s")).select("block", "number", "s.side", "s.t")
    words = both.select("block", "number", "side", F.explode(F.split("t", SPACE)).alias("word")).where("word != ''")
    counted = words.groupBy("block", "number", "side", "word").agg(F.count("*").alias("n"))
    weighted = counted.select(
        "block", "number", "side", F.xxhash64("word").alias("h"), F.log(F.col("n").cast("double")).alias("lw")
    )
    least = [F.min(draw(F.col("h"), F.col("lw"), k)).alias(f"s{k}") for k in range(samples)]
    drawn = weighted.groupBy("block", "number", "side").agg(*least)
    # 32 bits of each sample are enough to tell samples apart.
    bits = [F.shiftright(F.xxhash64(f"s{k}"), 32).cast("int") for k in range(samples)]
    return drawn.select("block", "number", "side", F.array(*bits).alias("signature"))


def _text_of(signature: Column) -> Column:
    shown = F.transform(signature, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.coalesce(F.array_join(shown, ""), F.lit(""))


def _alike(one: Column, other: Column, samples: int) -> Column:
    same = F.size(F.filter(F.zip_with(one, other, lambda a, b: a == b), lambda equal: equal)) / F.lit(float(samples))
    return F.when(one.isNull() & other.isNull(), 1.0).when(one.isNull() | other.isNull(), 0.0).otherwise(same)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    spark = docs.sparkSession
    partitions = SPLITS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = _ordered(docs).withColumn("number", F.row_number().over(_order())).where("number = 1").select("block", "text")
    first = stored(first, "first-rows")
    firsts = stored(
        _after(first.select("block")).join(first.toDF("after", "after_text"), "after"), "after-blocks"
    )
    rows = _followed(docs, firsts, partitions)
    facts = rows.select(
        "block", "number", F.lit(FACTS).alias("side"), "doc_id", "next_block", "next_number",
        F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
    )
    # One job for both, so that they read the same shuffle of the text.
    made = stored(_signatures(rows, samples).unionByName(facts, allowMissingColumns=True), "signatures")

    def side(which: int, name: str, *keys: str) -> DataFrame:
        return made.where(F.col("side") == which).select(
            *(F.col(c).alias(k) for c, k in zip(("block", "number"), keys, strict=True)), F.col("signature").alias(name)
        )

    joined = (
        made.where(F.col("side") == FACTS).drop("side", "signature")
        .join(side(0, "own", "block", "number"), ["block", "number"], "left")
        .join(side(1, "edit", "block", "number"), ["block", "number"], "left")
        .join(side(0, "below", "next_block", "next_number"), ["next_block", "next_number"], "left")
    )
    own, edit, below = F.col("own"), F.col("edit"), F.col("below")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256",
        _text_of(own).alias("fingerprint"), _text_of(edit).alias("edited_fingerprint"),
        _alike(own, edit, samples).alias("near_edited"), _alike(own, below, samples).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
