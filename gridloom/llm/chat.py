"""Operator 10: chat formatting by event-sourced reconstruction.

A log of events (``conv_id``, ``message``, ``seq``, ``kind``, ``role``, ``text``) is partitioned by conversation and
message, sorted by sequence, and folded:

    message      begins a message with a role and a first text
    delta        appends streamed text
    edit         replaces the text so far
    regenerate   throws the text so far away; deltas that follow make the new one

An event for a message that was never begun begins it. ``message`` orders the messages of a conversation and may be of any
type that sorts; an event touches one message, so messages of one long conversation fold in different tasks. A fold
holds one message at a time, never a conversation.

Final messages are rendered one segment each,

    [INST] role newline text [/INST]      any role but assistant
    <s>text</s>                           assistant; the text is the part under the loss mask

with ``\\`` written twice and a ``\\`` put inside each of ``<s> </s> [INST] [/INST]`` where a text or role contains it
(and before a newline in a role), which can be undone exactly. A conversation's output is its segments in order.

Null role or text: empty. Repeated rows: a message each. Ties of a turn: by role, then text. Null turn: first. Empty
table: only the added conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.llm.common import table

PIECE = 512  # code points in a streamed delta
PROBE = "</s>[INST] ok [/INST]"
CONTROL = re.compile(r"([<\[])(/?(?:s>|INST\]))")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
ASKED = re.compile(r"\[INST\] ((?:[^\\\n]|\\.)*)\n(.*) \[/INST\]", re.DOTALL)
ANSWERED = re.compile(r"<s>(.*)</s>", re.DOTALL)
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    if role == "assistant":
        return f"<s>{escape(text)}</s>"
    return "[INST] " + escape(role).replace("\n", "\\\n") + f"\n{escape(text)} [/INST]"


def parse(segment: str) -> tuple[str, str, bool]:
    """Role, text and whether the text is under the loss mask."""
    if found := ANSWERED.fullmatch(segment):
        return "assistant", unescape(found[1]), True
    found = ASKED.fullmatch(segment)
    if not found:
        raise ValueError("not a rendered turn")
    return unescape(found[1]), unescape(found[2]), False


def conversation_events(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """A table of turns as the log it would have been streamed as: a beginning and deltas of ``piece`` characters."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.select("conv_id", F.struct("turn", tie.alias("tie")).alias("message"), "role", "text")
    last = F.ceil(F.length("text") / F.lit(piece)).cast("int")
    numbered = rows.withColumn("seq", F.explode(F.sequence(F.lit(0), last)))
    part = F.col("text").substr((F.col("seq") - 1) * piece + 1, F.lit(piece))
    return numbered.select(
        "conv_id", "message", "seq",
        F.when(F.col("seq") == 0, "message").otherwise("delta").alias("kind"),
        F.when(F.col("seq") == 0, F.col("role")).alias("role"),
        F.when(F.col("seq") > 0, part).otherwise("").alias("text"),
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id``, ``message``, ``role``, ``text``."""
    log = events.select("conv_id", "message", "seq", "kind", "role", "text")
    kinds = {f.name: f.dataType for f in log.schema}
    schema = log.select("conv_id", "message", "role", "text").schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        key, role, parts = None, "", []
        begun = False
        for batch in batches:
            types = [batch.schema.field(n).type for n in ("conv_id", "message", "role", "text")]
            done = []
            for conv, message, kind, who, text in zip(
                *(batch.column(n).to_pylist() for n in ("conv_id", "message", "kind", "role", "text")), strict=True
            ):
                if not begun or (conv, message) != key or kind == "message":
                    if begun:
                        done.append((*key, role, "".join(parts)))
                    key, role, parts, begun = (conv, message), "", [], True
                if kind in ("edit", "regenerate"):
                    parts = []
                if kind != "regenerate":
                    parts.append(text or "")
                role = who or role
            if done:
                yield _batch(done, types)
        if begun:
            yield _batch([(*key, role, "".join(parts))], types)

    def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "message", "role", "text"])

    assert kinds.keys() >= {"conv_id", "message"}
    keyed = log.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq")
    return keyed.mapInArrow(fold, schema)


def formatted(messages: DataFrame) -> DataFrame:
    """One rendered segment a message."""
    render_all = F.pandas_udf(lambda r, t: r.combine(t, lambda a, b: render(a or "", b or "")), "string")
    return messages.select("conv_id", "message", render_all("role", "text").alias("segment"))


def digests(segments: DataFrame) -> DataFrame:
    """What a reader of the output finds in each conversation.

    A digest of a whole conversation needs its turns one after another; they stream through it, one at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv = False, None
        for batch in batches:
            done = []
            for key, segment in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or key != conv:
                    if begun:
                        done.append(_row(conv, state, turns, loss))
                    begun, conv, state, turns, loss = True, key, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                role, text, learned = parse(segment)
                turns.update(f"{role}\n{text}\n".encode())
                state[0] += 1
                state[1] += len(segment)
                if learned:
                    state[2] += len(text)
                    loss.update(text.encode())
            if done:
                yield _table(done)
        if begun:
            yield _table([_row(conv, state, turns, loss)])

    def _row(conv, state, turns, loss) -> tuple:
        return conv, state[0], turns.hexdigest(), state[2], loss.hexdigest(), state[1]

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in DIGESTS.split(", ")])

    ordered = segments.select("conv_id", "message", "segment").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "message").mapInArrow(read, DIGESTS)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE)
    )
    messages = reconstruct(conversation_events(turns.union(probe)))
    return digests(stored(formatted(messages), "chat"))


def _sql_escaped(value: str) -> str:
    value = f"replace({value}, '\\', '\\\\')"
    for control in ("<s>", "</s>", "[INST]", "[/INST]"):
        value = f"replace({value}, '{control}', '{control[0]}\\{control[1:]}')"
    return value


EXPECTED_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN 7 + length({_sql_escaped('text')})
    ELSE 16 + length(replace({_sql_escaped('role')}, chr(10), '\\' || chr(10))) + length({_sql_escaped('text')}) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
