"""Operator 13: a prefix trie over conversations by ROLLUP of positional turn ids.

A node is a distinct sequence of a conversation's first d turns; the root (d = 0) has no turn. Turns are known by 128 bits
of SHA-256 over role and text. Conversations lie in rows of ``BLOCK`` positional turn columns, and

* one ``GROUP BY key, ROLLUP(t1, ..)`` makes all prefixes of a block at once; ``grouping_id`` tells how deep each is, and a group
  whose last column is null is no prefix (the conversation was shorter);
* conversations that go on behind a block, together with others, are keyed by the block's last node and grouped in the next
  block; a conversation that is alone in its node has a plain path from there on and needs no grouping;
* sums over subtrees are a second ROLLUP over the nodes of a block, deepest block first; what a block adds up to is
  carried to the node that keys it.

Groups are pre-aggregated before they move, so a turn that most conversations begin with is a row a task. The list
of conversations that end in a node is hashed in pieces of ``PIECE`` ids, read one after another in constant memory.

``rebuilt`` swaps the first turns of a conversation for those of its base, as the query asks; ``trie`` takes any
conversations. Turns are ordered by turn, null first, ties by turn id. Null role or text: empty. Rows without
conv_id belong to no conversation. Repeated rows are turns of their own. Empty table: no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.ordering import running_total
from gridloom.functions.shared import stored
from gridloom.llm.common import table

BLOCK = 8
PIECE = 4096
EVERY, HEADS = 20, 4  # the query's bases are conversations divisible by the first; fewer turns than the second are swapped
ROOT = "unhex('00')"
WORD = r"[^ \t\n\x0B\f\r]+"
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` from 1 and ``t`` (id of the turn, words of its text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    t = F.struct(
        F.unhex(F.substring(F.sha2(framed, 256), 1, 32)).alias("h"), F.regexp_count(text, F.lit(WORD)).alias("w")
    )
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", t.alias("t"))
    return running_total(rows, [F.col("turn"), F.col("t")], "pos", within=["conv_id"]).select("conv_id", "pos", "t")


def _lengths(placed: DataFrame) -> DataFrame:
    return placed.groupBy("conv_id").agg(F.count("*").alias("length"))


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and their lengths: all conversations, turnless ones too."""
    own = _lengths(placed).select(
        "conv_id", F.col("length").alias("own"), (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"),
    )
    bases = own.where(f"conv_id % {EVERY} = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = own.join(bases, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")
    )
    convs = stored(convs, "conversations")
    heads = placed.where(f"conv_id % {EVERY} = 0 and pos < {HEADS}").select(F.col("conv_id").alias("base"), "pos", "t")
    swapped = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "t")
    behind = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h")
    kept = behind.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t")
    return swapped.union(kept), convs.select("conv_id", "length")


def _node(block: int) -> Column:
    """Id of the node that the columns of a row spell: its key and the turns behind it."""
    spelt = F.concat("key", *(F.coalesce(F.col(f"t{j}.h"), F.unhex(F.lit(""))) for j in range(1, block + 1)))
    return F.when(F.col("t1").isNull(), F.col("key")).otherwise(F.unhex(F.substring(F.sha2(spelt, 256), 1, 32)))


def _prefixes(rows: DataFrame, block: int, before: int) -> DataFrame:
    """Nodes of a block: the groups of a rollup that spell a prefix."""
    names = [f"t{j}" for j in range(1, block + 1)]
    listed = ", ".join(names)
    grouped = rows.sparkSession.sql(
        f"SELECT key, {listed}, {block} - bit_count(grouping_id()) AS d, count(*) AS n_convs, min(conv_id) AS conv_id,"
        f" max(length) AS longest FROM {{rows}} GROUP BY key, ROLLUP({listed})",
        rows=rows,
    )
    spelt = reduce(Column.__add__, (F.col(c).isNotNull().cast("int") for c in names))
    d, last = F.col("d"), F.coalesce(*(F.col(f"{c}.w") for c in reversed(names)), F.lit(0))
    up = F.concat("key", *(F.when(d > j, F.col(f"t{j}.h")).otherwise(F.unhex(F.lit(""))) for j in range(1, block)))
    parent = F.when(d > 1, F.unhex(F.substring(F.sha2(up, 256), 1, 32))).when(d == 1, F.col("key"))
    return grouped.where((spelt == d) & ((d > 0) | F.lit(before == 0))).select(
        "key", *names, "d", _node(block).alias("node"), parent.alias("parent"), (d + before).alias("depth"), "n_convs", "conv_id",
        (F.col("longest") == d + before).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * last).alias("saved"),
    )


def _summed(nodes: DataFrame, carried: DataFrame | None, block: int) -> DataFrame:
    """Nodes with the sums over their subtrees; a row of depth 0 in a later block holds what its key gets."""
    names = [f"t{j}" for j in range(1, block + 1)]
    listed = ", ".join(names)
    if carried is None:
        rows = nodes.selectExpr("*", "0L AS more_children", "0L AS more_leaves", "0L AS more_saved")
    else:
        added = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("more_children", "more_leaves", "more_saved")}
        rows = nodes.join(carried, "node", "left").withColumns(added)
    children = ", ".join(f"count_if(d = {j})" for j in range(1, block + 1))
    grouped = nodes.sparkSession.sql(
        f"SELECT key, {listed}, {block} - bit_count(grouping_id()) AS at, sum(saved + more_saved) AS saved_tokens,"
        f" sum(leaf + more_leaves) AS n_leaves, array({children}, sum(more_children)) AS below,"
        " min(struct(d, node, parent, depth, n_convs, conv_id)) AS own"
        f" FROM {{rows}} GROUP BY key, ROLLUP({listed})",
        rows=rows,
    )
    spelt = reduce(Column.__add__, (F.col(c).isNotNull().cast("int") for c in names))
    return grouped.where(spelt == F.col("at")).select(
        "key", "at", "own.*", F.element_at("below", F.col("at") + 1).alias("n_children"), "n_leaves", "saved_tokens"
    )


def _ends(members: DataFrame) -> DataFrame:
    """``node`` and the hash of the ids of its members, ascending and joined by commas."""
    placed = running_total(members, [F.col("conv_id")], "place", within=["node"])
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = placed.groupBy("node", F.expr(f"(place - 1) div {PIECE}").alias("piece")).agg(F.concat_ws(",", ids).alias("ids"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for batch in batches:
            done = []
            for this, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if this == node:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    done.append((node, state.hexdigest()))
                node, state = this, hashlib.sha256(ids.encode())
            yield made(done)
        if state:
            yield made([(node, state.hexdigest())])

    def made(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], ["node", "ends_sha256"])

    ordered = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids")
    return ordered.mapInArrow(fold, "node binary, ends_sha256 string")


def trie(placed: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes over conversations given by their turns (``conv_id``, ``pos``, ``t``) and ``length``."""
    where = F.expr(f"(pos - 1) div {block}").alias("block")
    columns = [F.first(F.when((F.col("pos") - 1) % block == j, F.col("t")), ignorenulls=True).alias(f"t{j + 1}") for j in range(block)]
    blocks = stored(placed.groupBy("conv_id", where).agg(*columns), "blocks")
    longest = convs.agg(F.max("length")).first()[0] or 0
    rows = stored(convs.join(blocks.where("block = 0").drop("block"), "conv_id", "left").withColumn("key", F.expr(ROOT)), "rows")
    levels, members, tails = [], [], []
    while True:
        before = len(levels) * block
        nodes = stored(_prefixes(rows, block, before), "nodes")
        levels.append(nodes)
        members.append(rows.where(F.col("length") <= before + block).select(_node(block).alias("node"), "conv_id"))
        if longest <= before + block:
            break
        onward = rows.where(F.col("length") > before + block).select("conv_id", "length", _node(block).alias("key"))
        shared = nodes.where(f"d = {block} and n_convs > 1").select(F.col("node").alias("key"))
        tails.append(onward.join(shared, "key", "left_anti").withColumn("before", F.lit(before + block)))
        together = onward.join(shared, "key", "left_semi")
        rows = stored(together.join(blocks.where(f"block = {len(levels)}").drop("block"), "conv_id"), "rows")
        if not rows.take(1):
            break
    found, carried, below = [], None, None
    for k in reversed(range(len(levels))):
        alone = tails[k].groupBy(F.col("key").alias("node")).agg(F.count("*").alias("more_children")) if k < len(tails) else None
        if alone is not None:
            carried = alone.selectExpr("node", "more_children", "more_children AS more_leaves", "0L AS more_saved")
            carried = carried if below is None else carried.union(below)
        summed = stored(_summed(levels[k], carried, block), "summed")
        below = summed.where("at = 0").select(F.col("key").alias("node"), "n_children", "n_leaves", "saved_tokens")
        found.append(summed.where("at > 0 or depth = 0"))
    together = reduce(DataFrame.union, found)
    parents = reduce(DataFrame.union, (n.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")) for n in levels))
    whole = together.join(parents, "parent", "left").join(_ends(reduce(DataFrame.union, members)), "node", "left")
    shared_nodes = whole.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    return reduce(DataFrame.union, (_paths(t, placed) for t in tails), shared_nodes)


def _paths(tail: DataFrame, placed: DataFrame) -> DataFrame:
    """Nodes of conversations that are alone behind depth ``before``."""
    last, one = F.col("pos") == F.col("length"), F.lit(1).cast("long")
    return placed.join(tail, "conv_id").where("pos > before").select(
        "conv_id", F.col("pos").cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, convs = rebuilt(stored(turns(table(spark, sf_dir, "conversations")), "turns"))
    return trie(stored(placed, "rebuilt"), convs)


EXPECTED_SQL = f"""
WITH crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384)
        ELSE c >> 1 END) ORDER BY i) AS steps
    FROM range(256) AS r(i)
),
placed AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
    SELECT conv_id, own, conv_id - conv_id % {EVERY} AS base, xor(list_reduce(
        list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1])), 4294967295) % {HEADS} AS h
    FROM (SELECT conv_id, count(*) AS own FROM placed GROUP BY conv_id), crc_table
),
moved AS (
    SELECT c.conv_id, p.pos, p.t, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
    UNION ALL
    SELECT c.conv_id, p.pos - c.h + least(c.h, coalesce(b.own, 0)), p.t, p.text
    FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h LEFT JOIN convs b ON b.conv_id = c.base
),
prefixes AS (
    SELECT conv_id, 0 AS d, '' AS node, NULL AS parent, 0 AS words FROM convs
    UNION ALL
    SELECT conv_id, pos, string_agg(t, '') OVER so_far, coalesce(string_agg(t, '') OVER earlier, ''),
        len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))
    FROM moved
    WINDOW so_far AS (PARTITION BY conv_id ORDER BY pos),
        earlier AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
lengths AS (SELECT conv_id, max(d) AS length FROM prefixes GROUP BY conv_id),
nodes AS (
    SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * any_value(words) AS saved, max(length) = any_value(d) AS leaf,
        sha256(coalesce(string_agg(CASE WHEN length = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM prefixes JOIN lengths USING (conv_id) GROUP BY node
),
below AS (
    SELECT p.node, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves
    FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs,
    (SELECT count(*) FROM nodes c WHERE c.parent = n.node) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN nodes u ON u.node = n.parent
"""
