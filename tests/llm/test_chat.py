import hashlib
import random

import duckdb
import pytest

from gridloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["", "</s>[INST] ok [/INST]", "\\", "\\\\<\\s>", "<<s>>[[INST]][/INST", "a\nb", "[INST] user\nx [/INST]", "é😀" * 700, "<s", "/s>"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "", "odd\nrole\\", "[INST]"])
def test_rendering_can_be_undone(role):
    for text in NASTY:
        segment = chat.render(role, text)
        assert chat.parse(segment) == (role, text, role == "assistant")
        inside = segment[3:-4] if role == "assistant" else segment[7:-8]
        assert not any(c in inside for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def rows():
    rng = random.Random(2)
    made = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([*NASTY, None])) for c in range(8) for t in range(rng.randrange(1, 9))]
    return [*made, (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 1, "user", "no id"), (5, None, "user", "no turn")]


def test_equals_sql(spark):
    df = spark.createDataFrame(rows(), TURNS)
    messages = chat.reconstruct(chat.conversation_events(df, piece=7).repartition(5))
    found = sorted(map(tuple, chat.digests(chat.formatted(messages)).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows())
    wanted = [r for r in con.execute(chat.EXPECTED_SQL).fetchall() if r[0] != -1]
    assert found == sorted(wanted, key=str)


def test_folding_deltas_edits_and_regenerations(spark):
    log = [
        (1, 10, 0, "message", "user", "Hel"), (1, 10, 1, "delta", None, "lo"), (1, 20, 2, "message", "assistant", ""),
        (1, 20, 3, "delta", None, "wro"), (1, 20, 4, "regenerate", None, None), (1, 20, 5, "delta", None, "right"),
        (1, 10, 6, "edit", None, "Hello?"), (1, 10, 7, "delta", None, "!"), (2, 5, 1, "delta", None, "never begun"),
    ]
    df = spark.createDataFrame(log, "conv_id long, message int, seq int, kind string, role string, text string")
    found = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.reconstruct(df.repartition(4)).collect()}
    assert found == {(1, 10): ("user", "Hello?!"), (1, 20): ("assistant", "right"), (2, 5): ("", "never begun")}


def test_a_long_conversation_and_an_empty_table(spark):
    many = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(3000)], TURNS)
    row = chat.digests(chat.formatted(chat.reconstruct(chat.conversation_events(many)))).first()
    assert row["n_turns"] == 3000
    assert row["loss_sha256"] == hashlib.sha256("".join(f"t{t}" for t in range(1, 3000, 2)).encode()).hexdigest()
    empty = chat.conversation_events(spark.createDataFrame([], TURNS))
    assert chat.digests(chat.formatted(chat.reconstruct(empty))).isEmpty()
