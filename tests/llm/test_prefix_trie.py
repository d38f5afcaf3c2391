import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from gridloom.llm import prefix_trie
from gridloom.llm.prefix_trie import EXPECTED_SQL, op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """Turns as (role, text) of every rebuilt conversation."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, role or "", text or ""))

    def order(t):
        framed = f"{len(t[2].encode())}:{t[2]}{t[3]}"
        return t[0], t[1], hashlib.sha256(framed.encode()).hexdigest()

    own = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in held.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + ts[h:]
    return made


def brute(rows):
    made = rebuilt(rows)
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    words = {n: len(re.findall(r"[^ \t\n\x0b\f\r]+", n[-1][1])) if n else 0 for n in members}
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        children[n[:-1]] += bool(n)
    for n, cs in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(cs) - 1) * words[n]
            leaves[n[:d]] += n not in children
    leaves = {n: leaves[n] for n in members}
    found = []
    for n, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(n))
        found.append((
            min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children.get(n, 0), leaves[n], saved[n],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return found


def sample():
    long = [("user" if k % 2 else "assistant", f"turn {k} of many") for k in range(21)]
    rows = [(c, k, *t) for c in (3, 20, 23, 24, 31) for k, t in enumerate(long[: 21 - c % 7])]
    rows += [(c, k, "user", f"all {k}") for c in range(100, 160) for k in range(2 + c % 3)]
    rows += [
        (40, 0, "user", "x"), (40, 1, "assistant", None), (41, None, None, None), (41, 0, "user", "late"), (41, 0, "tool", "tie"),
        (41, 0, "tool", "tie"), (-3, 0, "user", "below"), (-3, 1, "user", "zero"), (0, 0, "a", "bc"), (1, 0, "ab", "c"),
        (None, 0, "user", "nobody"), (47, 0, "user", ""), (48, 5, "user", " \t "), (5, 0, "user", "w " * 50_000), (26, 0, "user", "only"),
    ]
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("piece", [4096, 7])
def test_nodes_equal_brute_force_and_sql(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS pos", "'mine' AS t", "'mine' AS key", "'mine' AS d")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_prefix_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == sorted(brute(rows), key=str)
    assert max(r[1] for r in found if r[3] > 1) > prefix_trie.BLOCK  # shared beyond a block
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert found == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({EXPECTED_SQL})").fetchall(), key=str)


def test_any_width_of_a_block_gives_the_same_nodes(spark):
    df = spark.createDataFrame([r for r in sample() if r[0] in (3, 20, 23, 24, 31, 40)], SCHEMA)
    placed, convs = prefix_trie.rebuilt(prefix_trie.turns(df))
    results = [sorted((tuple(r) for r in prefix_trie.trie(placed, convs, block).collect()), key=str) for block in (3, 16)]
    assert results[0] == results[1] and len(results[0]) > 30


def test_no_conversations_no_nodes(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_prefix_trie(spark, str(tmp_path)).collect() == []
