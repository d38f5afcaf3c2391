"""Operator 8: n-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles; two link when ``100 * intersection >= percent * union``.

* **Sets.** Shingles are 64-bit hashes, made with numpy for a chunk of documents at a time. Equal sets are one *node*;
  copies therefore never become pairs.
* **Document frequency.** Chunks send each of their distinct shingles (cut to 40 bits, ascending, as byte planes of the
  differences) with a count to the task that owns its range of hashes, and get back how often the corpus has it. That
  gives a global order, rarest first. Cut hashes may meet; this only changes the order.
* **Prefixes.** Of n shingles in that order, two linked sets share one among their first ``n - ceil(n * percent / 100) + 1``.
  Shingles that only one document has can't be shared; documents whose prefix has no other are done.
* **Groups.** Nodes of the same size with the same prefix form a group, which is posted once per shingle of its
  prefix. Pairs of groups are filtered by size and by the places of the shared shingle, then expanded to nodes
  and verified on their whole sets.
* **Links, not pairs.** A shingle's posting list can be as long as a group of near copies, so first every node is verified
  against ``STARS`` pivots of each list only, and against the first node of its group. For ``TURNS`` rounds, nodes outside the
  largest component of a list are verified against a few inside it. Then only pairs in different components are left to be
  verified, found by joining a list's nodes outside its largest component with the rest of the list. No
  pair of different components is left out, so the components are exact.
* **Bitmaps.** A node has ``BITS`` parity bits: each shingle turns one over. Two bitmaps differ in no more bits than
  the sets differ in shingles, and a link allows ``(100 - percent) / (100 + percent)`` of both sizes together. Pairs beyond that
  never become rows of the joins. Nodes of one group and component are bounded together, by the bits that all of them agree on.

The text is shuffled once, into chunks of about ``CHUNK_BYTES``; both passes over it read the same shuffle files. Lists,
pivots and hubs are joined through tables, where adaptive execution splits a hot key.

Null or empty text, or white space alone: the empty set, linked with nothing. Fewer words than a shingle: the sequence as
the one shingle. Null doc_id: a document without a number; repeated rows: equal sets. Ties: components are
named by their smallest doc_id. Empty table: no rows. Other columns are ignored, and passed through by
``one_of_each_group``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.llm.common import documents, freeing, released, table
from gridloom.llm.components import components
from gridloom.llm.word_encoder import slices

WORDS = 5
PERCENT = 75
STARS = 2  # pivots of each posting list that its nodes are verified against first
TURNS = 1  # rounds in which nodes outside a list's largest component are verified against some inside it
TRIES = 12  # partners of a group in each of those rounds
CHUNK_BYTES = 10 << 20
CUT = 24  # low bits left out where frequencies are counted
PLANES = 5  # bytes that hold a 40-bit difference
CELL = 64  # shingles that a row of the count should hold at least
BITS = 256  # parity bits of a node, in words of 64
U64 = np.uint64
ROWS = (
    "kind string, doc_id long, n_shingles long, node string, grp string, token long, place long, shingles binary,"
    " digest binary, bits array<long>"
)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    ends = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    unique = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in unique), U64, len(unique))
    which = coded.indices.to_numpy(zero_copy_only=False)
    real = np.array([bool(w) for w in unique], bool)[which] if unique else np.zeros(0, bool)
    behind = np.concatenate([[0], np.cumsum(real)])
    return hashes[which][real], behind[ends - ends[0]]


def _shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, document after document, and where each document's begin."""
    hashes, ends = _word_hashes(texts)
    counts = np.diff(ends)
    factor = _multipliers(words + 1)
    whole = np.maximum(counts - words + 1, 0)
    short = (counts > 0) & (counts < words)
    n = whole + short
    begins = np.concatenate([[0], np.cumsum(n)])
    found = np.zeros(begins[-1], U64)
    start = np.repeat(ends[:-1] - begins[:-1], n) + np.arange(begins[-1])  # first word of each shingle
    full = np.repeat(whole > 0, n)
    for k in range(words):
        found[full] += hashes[start[full] + k] * factor[k]
    for size in range(1, words):  # whole texts of fewer words
        rows = begins[:-1][short & (counts == size)]
        for k in range(size):
            found[rows] += hashes[start[rows] + k] * factor[k]
        found[rows] += np.full(len(rows), size, U64) * factor[words]
    return mixed(found), begins


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Ascending distinct hashes of each text."""
    for _, part in slices(texts, 4 << 20):
        found, begins = _shingles(part, words)
        for k in range(len(begins) - 1):
            one = np.sort(found[begins[k] : begins[k + 1]])
            yield one[np.concatenate([[True], one[1:] != one[:-1]])] if len(one) else one


def node_name(shingles: np.ndarray) -> str | None:
    return f"{xxhash.xxh3_128_hexdigest(shingles.tobytes())}{len(shingles):x}" if len(shingles) else None


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` bits as signed words, each the parity of the number of shingles that fall on it."""
    odd = np.bincount((mixed(shingles) % U64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _nodes(chunk: pa.Table, words: int) -> tuple[list[tuple], dict[str, np.ndarray]]:
    """(doc_id, size, node) of each row and the set of each node, in an order that both passes repeat."""
    texts = chunk.column("text").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    rows, sets = [], {}
    for key, one in zip(chunk.column("doc_id").to_pylist(), shingle_sets(texts, words), strict=True):
        name = node_name(one)
        rows.append((key, len(one), name))
        if name:
            sets.setdefault(name, one)
    return rows, sets


def _cut_tokens(sets: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(list(sets.values())) if sets else np.zeros(0, U64)
    return np.unique(every >> U64(CUT), return_counts=True)


def _planes(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplaned(data: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(width, -1)
    wide = np.zeros((flat.shape[1], 8), np.uint8)
    wide[:, :width] = flat.T
    return wide.view("<u8").ravel()


def _ranges(tokens: np.ndarray, buckets: int) -> np.ndarray:
    edges = (np.arange(1, buckets, dtype=object) << (64 - CUT)) // buckets
    return np.concatenate([[0], np.searchsorted(tokens, edges.astype(U64)), [len(tokens)]])


def _sent(chunk: pa.Table, words: int, buckets: int) -> pa.Table:
    part = chunk.column("part")[0].as_py()
    tokens, counts = _cut_tokens(_nodes(chunk.select(["doc_id", "text"]), words)[1])
    cut = _ranges(tokens, buckets)
    rows = []
    for b in range(buckets):
        lo, hi = cut[b], cut[b + 1]
        if hi > lo:
            steps = np.diff(tokens[lo:hi], prepend=U64(0))
            rows.append((b, part, _planes(steps, PLANES) + np.minimum(counts[lo:hi], 255).astype(np.uint8).tobytes()))
    names, types = ["bucket", "part", "tokens"], [pa.int32(), pa.int32(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _counted(sent: pa.Table) -> pa.Table:
    """Corpus frequency of each token sent, in the order sent: two bytes each, the largest value for any more."""
    parts, tokens, counts = sent.column("part").to_pylist(), [], []
    for cell in sent.column("tokens"):
        data = cell.as_buffer()
        n = data.size // (PLANES + 1)
        tokens.append(np.cumsum(_unplaned(data[: n * PLANES], PLANES)))
        counts.append(np.frombuffer(data, np.uint8, offset=n * PLANES))
    _, which = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.minimum(np.bincount(which, np.concatenate(counts)), 65535).astype("<u2")
    ends = np.cumsum([len(t) for t in tokens])[:-1]
    answers = [a.tobytes() for a in np.split(total[which], ends)]
    return pa.Table.from_arrays(
        [sent.column("bucket"), pa.array(parts, pa.int32()), pa.array(answers, pa.binary())],
        names=["bucket", "part", "counts"],
    )


def _posted(chunk: pa.Table, answers: pa.Table, words: int, percent: int) -> pa.Table:
    rows, sets = _nodes(chunk.select(["doc_id", "text"]), words)
    order = np.argsort(answers.column("bucket").to_numpy())
    cells = answers.column("counts").to_pylist()
    frequency = np.concatenate([np.frombuffer(cells[k], "<u2") for k in order]) if cells else np.zeros(0, np.uint16)
    tokens = _cut_tokens(sets)[0]
    out: dict[str, list] = {f.split()[0]: [] for f in ROWS.split(", ")}

    def add(**given) -> None:
        for name, cells in out.items():
            cells.append(given.get(name))

    for (key, n, name), text in zip(rows, chunk.column("text"), strict=True):
        add(kind="row", doc_id=key, n_shingles=n, node=name, digest=hashlib.md5(text.as_buffer()).digest())
    seen = set()
    for name, one in sets.items():
        n = len(one)
        length = n - -(-n * percent // 100) + 1
        often = frequency[np.searchsorted(tokens, one >> U64(CUT))]
        if np.count_nonzero(often < 2) >= length:
            continue
        first = np.argsort(often, kind="stable")[:length]
        prefix = one[first]
        group = f"{xxhash.xxh3_128_hexdigest(prefix.tobytes())}{n:x}"
        add(kind="node", node=name, grp=group, n_shingles=n, shingles=one.tobytes(), bits=parity_bits(one))
        if group not in seen:
            seen.add(group)
            for place in np.nonzero(often[first] > 1)[0].tolist():
                add(kind="post", grp=group, n_shingles=n, place=place, token=int(prefix[place].view(np.int64)))
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    types.append(pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], names=list(out))


def postings(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (doc_id, size, node), nodes worth comparing with their sets, and the posted prefixes of their groups."""
    mine = documents(docs)
    volume = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-volume // CHUNK_BYTES))
    # A null adds nothing to the hash: documents without a number are dealt by their text.
    dealt = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    chunks = mine.withColumn("part", F.pmod(dealt, F.lit(parts)).cast("int")).repartition(parts, "part")
    # About one shingle to seven bytes; rows of the count grow with the text, also where chunks are very many.
    buckets = max(1, min(parts, CHUNK_BYTES // 7 // CELL))
    sent = chunks.groupBy("part").applyInArrow(
        lambda t: released(_sent(t, words, buckets)), "bucket int, part int, tokens binary"
    )
    answers = sent.groupBy("bucket").applyInArrow(lambda t: released(_counted(t)), "bucket int, part int, counts binary")
    both = chunks.groupBy("part").cogroup(answers.groupBy("part"))
    found = both.applyInArrow(lambda left, right: released(_posted(left, right, words, percent)), ROWS)
    path_kept = stored(found, "jaccard")
    return path_kept


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough."""

    @freeing
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("a"), batch.column("b")
            keep = []
            for x, y in zip(left, right, strict=True):
                a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.sort(np.concatenate([a, b]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(kept) for n in ("u", "v")], names=["u", "v"])

    sets = nodes.select("node", "shingles")
    joined = pairs.join(sets.toDF("u", "a"), "u").select("u", "v", "a").join(sets.toDF("v", "b"), "v")
    return joined.select("u", "v", "a", "b").mapInArrow(similar, "u string, v string")


def _fits(one: str, other: str, percent: int):
    """Size filter for two nodes or groups given by the names of their size columns."""
    small, large = F.least(one, other), F.greatest(one, other)
    return small * 100 >= large * percent


def _room(a: str, b: str, percent: int):
    """Whether the places of a shared shingle leave enough for the overlap that a link needs.

    The first shared shingle of a link never lies too far back, and one shingle that passes is enough for
    a pair to be verified, so the filter loses nothing.
    """
    left = 1 + F.least(F.col(f"{a}n") - F.col(f"{a}place") - 1, F.col(f"{b}n") - F.col(f"{b}place") - 1)
    return left * (100 + percent) >= (F.col(f"{a}n") + F.col(f"{b}n")) * percent


def _stars(posts: DataFrame, members: DataFrame, heads: DataFrame, stars: int, percent: int) -> DataFrame:
    """Pairs of nodes: each with pivots of its lists, each with the head of its group."""
    picks = [
        F.min(F.struct(F.xxhash64(F.lit(k), "grp").alias("key"), "grp", "n")).alias(f"p{k}") for k in range(stars)
    ]
    lists = posts.groupBy("token").agg(F.count("*").alias("size"), *picks).where("size > 1")
    pivots = stored(
        lists.select("token", F.explode(F.array(*(f"p{k}" for k in range(stars)))).alias("p")).select(
            "token", F.col("p.grp").alias("pivot"), F.col("p.n").alias("pivot_n")
        ),
        "pivots",
    )
    to_pivot = (
        posts.join(pivots, "token")
        .where((F.col("grp") != F.col("pivot")) & _fits("n", "pivot_n", percent))
        .select("grp", "pivot")
        .distinct()
    )
    # The pivot of a list stands for its group by the group's first node; every member of the other group meets it.
    across = (
        stored(to_pivot, "to-pivot")
        .join(heads.select(F.col("grp").alias("pivot"), F.col("head").alias("v")), "pivot")
        .join(members.select("grp", F.col("node").alias("u")), "grp")
        .select("u", "v")
    )
    within = members.join(heads, "grp").where("node != head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    pairs = across.union(within).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pairs.distinct()


# Columns for the bits that all nodes of a side have, and for those that any has. Plain numbers: code for arrays is too long to compile.
MASKS = [f"{kind}{k}" for kind in ("all", "any") for k in range(BITS // 64)]


def _differing(one: str, other: str):
    """Bits that are set in all nodes of one side and in none of the other, or the other way round."""
    sql = (f"bit_count(({one}all{k} & ~{other}any{k}) | ({other}all{k} & ~{one}any{k}))" for k in range(BITS // 64))
    return F.expr(" + ".join(sql))


def _near(one: str, other: str, percent: int):
    """Whether the bitmaps leave a link possible."""
    return _differing(one, other) * (100 + percent) <= (F.col(f"{one}n") + F.col(f"{other}n")) * (100 - percent)


def _contested(posts: DataFrame, members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their component, and the lists where several components meet, each with its largest (``top``).

    A group within one component is one entry of a list, with the bits that all or any of its nodes have.
    """
    named = stored(
        members.join(labels, "node", "left").select("grp", "node", "n", "bits", F.coalesce("root", "node").alias("root")),
        "named-members",
    )
    words = range(BITS // 64)
    couples = named.groupBy("grp", "root").agg(
        *(F.bit_and(F.col("bits")[k]).alias(f"all{k}") for k in words), *(F.bit_or(F.col("bits")[k]).alias(f"any{k}") for k in words)
    )
    held = stored(posts.join(named.select("grp", "root").distinct(), "grp"), "held")
    most = held.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(
        F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("top")
    )
    open_lists = stored(most.where("roots > 1").select("token", F.col("top.root").alias("top")), "open-lists")
    return named, stored(held.join(open_lists, "token").join(couples, ["grp", "root"]), "contested")


def _expanded(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups with the components meant, as pairs of their nodes that may be similar."""

    def side(name: str, node: str) -> DataFrame:
        bits = F.col("bits")
        return named.select(
            F.col("grp").alias(f"{name}g"), F.col("root").alias(f"{name}r"), F.col("n").alias(f"{name}n"),
            *(bits[int(w[3:])].alias(f"{name}{w}") for w in MASKS), F.col("node").alias(node),
        )

    expanded = pairs.join(side("a", "u"), ["ag", "ar"]).join(side("b", "v"), ["bg", "br"]).where(_near("a", "b", percent))
    return expanded.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _side(contested: DataFrame, name: str) -> DataFrame:
    return contested.select(
        "token", F.col("grp").alias(f"{name}g"), F.col("root").alias(f"{name}r"), F.col("n").alias(f"{name}n"),
        F.col("place").alias(f"{name}place"), *(F.col(w).alias(f"{name}{w}") for w in MASKS),
    )


def _towards_largest(
    posts: DataFrame, members: DataFrame, labels: DataFrame, percent: int, turn: int
) -> DataFrame:
    """Each group outside the largest component of its lists with a few groups inside it, others in every turn.

    A group gets the ``TRIES`` partners it shares most lists with, so pairs grow with groups.
    """
    named, contested = _contested(posts, members, labels)
    inside = contested.where("root = top")
    one = ("grp", "root", "n", *MASKS)
    picks = [F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(k), "grp"), *one)) for k in range(TRIES)]
    chosen = inside.groupBy("token").agg(*(p.alias(f"p{k}") for k, p in enumerate(picks)))
    chosen = stored(
        chosen.select("token", F.explode(F.array(*(f"p{k}" for k in range(TRIES)))).alias("p")).select(
            "token", F.col("p.grp").alias("bg"), F.col("p.root").alias("br"), F.col("p.n").alias("bn"),
            *(F.col(f"p.{w}").alias(f"b{w}") for w in MASKS),
        ).dropDuplicates(["token", "bg", "br"]),
        "inside-pivots",
    )
    met = (
        _side(contested.where("root != top"), "a")
        .join(chosen, "token")
        .where(_fits("an", "bn", percent) & _near("a", "b", percent))
        .groupBy("ag", "ar", "bg", "br")
        .agg(F.count("*").alias("shared"))
    )
    rank = F.row_number().over(Window.partitionBy("ag", "ar").orderBy(F.desc("shared"), "bg", "br"))
    best = stored(met.withColumn("rank", rank).where(F.col("rank") <= TRIES).select("ag", "ar", "bg", "br"), "towards")
    return _expanded(best, named, percent)


def _remaining(posts: DataFrame, members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes that share a posted shingle, may be similar, and are in different components."""
    named, contested = _contested(posts, members, labels)
    met = (
        _side(contested.where("root != top"), "a")
        .join(_side(contested, "b"), "token")
        .where((F.col("ar") != F.col("br")) & _fits("an", "bn", percent) & _room("a", "b", percent) & _near("a", "b", percent))
        .select("ag", "ar", "bg", "br")
        .distinct()
    )
    # Nodes of one group in different components share their whole prefix.
    inside = named.select(F.col("grp").alias("ag"), F.col("root").alias("ar")).distinct()
    split = inside.groupBy("ag").agg(F.count("*").alias("roots"), F.max("ar").alias("top")).where("roots > 1")
    apart = inside.join(split, "ag").where("ar != top").select("ag", "ar").join(
        inside.select("ag", F.col("ar").alias("br")), "ag"
    ).where("ar != br").select("ag", "ar", F.col("ag").alias("bg"), "br")
    return _expanded(stored(met.union(apart), "group-pairs"), named, percent)


def _rooted(docs: DataFrame, words: int, percent: int, stars: int, turns: int) -> tuple[DataFrame, DataFrame]:
    """Rows with words, each with the name of its component (``root``) and a digest of its text, and those without."""
    found = postings(docs, words, percent)
    rows = found.where("kind = 'row'").select("doc_id", "n_shingles", "node", "digest")
    worth = found.where("kind = 'node'").select("node", "grp", "n_shingles", "shingles", "bits")
    nodes = stored(worth.dropDuplicates(["node"]), "nodes")
    posts = found.where("kind = 'post'").select("token", "grp", F.col("n_shingles").alias("n"), "place")
    posts = stored(posts.distinct(), "posts")
    members = nodes.select("grp", "node", F.col("n_shingles").alias("n"), "bits")
    heads = stored(members.groupBy("grp").agg(F.min("node").alias("head")), "heads")
    links = stored(_verified(_stars(posts, members, heads, stars, percent), nodes, percent), "star-links")
    labels = stored(components(links), "labels")
    for turn in range(turns):
        more = stored(_verified(_towards_largest(posts, members, labels, percent, turn), nodes, percent), "more-links")
        if not more.take(1):
            break
        links = links.union(more)
        labels = stored(components(links), "labels")
    rest = stored(_verified(_remaining(posts, members, labels, percent), nodes, percent), "rest-links")
    if rest.take(1):
        labels = stored(components(links.union(rest)), "labels")
    named = stored(
        rows.where("node is not null")
        .join(labels, "node", "left")
        .select("doc_id", "n_shingles", "digest", F.coalesce("root", "node").alias("root")),
        "labelled",
    )
    return named, rows.where("node is null")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, stars: int = STARS, turns: int = TURNS
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    named, wordless = _rooted(docs, words, percent, stars, turns)
    lowest = stored(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    linked = named.join(lowest, "root").select("doc_id", "n_shingles", "component_id")
    alone = wordless.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def one_of_each_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: of the smallest doc_id; rows without words all stay.

    A row is known by doc_id and text, never by doc_id alone: unlinked texts under one doc_id, or without one, all
    stay. A row without a doc_id stands for its component only if no row of it has one. Ties: the smallest digest of the
    text; of equal rows one stays.
    """
    named, _ = _rooted(docs, words, percent, STARS, TURNS)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("row"))
    kept = stored(first.select(F.col("row.doc_id").alias("__id"), F.col("row.digest").alias("__kept")), "kept")
    worded = F.coalesce("text", F.lit("")).rlike(r"[^ \t-\r]")
    mine = docs.where(worded).withColumn("__digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    hits = mine.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept")), "left_semi")
    repeat = F.row_number().over(Window.partitionBy("doc_id", "__digest").orderBy("text"))
    one = hits.withColumn("__repeat", repeat).where("__repeat = 1").select(*docs.columns)
    return one.union(docs.where(~worded))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
