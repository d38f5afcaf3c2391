"""Operator 11: bytes repeated from other documents, by a suffix sort that compares with prefix hashes.

A byte goes if a string of ``SPAN`` bytes covers it that also starts in a document with a smaller doc_id. All suffixes that
have ``SPAN`` bytes in their text are sorted by these bytes; suffixes that agree in all of them are neighbours, and the
smallest doc_id among them decides for the rest.

* **Texts.** Equal texts are one text, known by a 128-bit digest; a task sends each of them once.
* **Dealing.** Texts lie in chunks of about ``CHUNK_BYTES``. A suffix is dealt by the least hash of the ``GRAM``-byte strings in its
  first ``SPAN`` bytes (its *anchor*), so suffixes that agree meet, and neighbouring suffixes mostly share an
  anchor and travel as one fragment of text. Chunks first send their distinct anchors alone, cut to 48 bits, to the task that
  owns their range, and learn which of them occur in another text; only fragments of those travel. Cut hashes may meet; this
  only lets more suffixes take part.
* **Hot anchors.** Equal fragments of a chunk are one. An anchor with more than ``HOT`` fragments sends its suffixes one by one,
  dealt by a hash of their bytes: what then meets is one row a chunk of each such suffix, whatever number of texts has it.
* **Sort.** Inside a task suffixes are cut into runs by their first eight bytes; in each run a merge sort goes on, all runs
  at once. It compares two suffixes by their longest common extension, found by binary search over prefix polynomial
  hashes, and by the byte behind it. Suffixes that the hashes call equal are compared byte by byte; if any differ, the task
  sorts again with other hashes.
* **Removal.** The smallest doc_id that each suffix's group has goes back to the chunk, where texts are cut.

The three passes over the chunks read the same shuffle files.

Null or empty text: nothing to remove. Null doc_id: later than every number, and equal to another null. Repeated rows and equal
doc_ids: one document, never compared with itself. Texts shorter than the span stay. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import documents, released, table

SPAN = 50
GRAM = 26
CHUNK_BYTES = 8 << 20
SEGMENT = 1 << 19  # bytes hashed at a time
SHARES = 8  # sorting tasks to a chunk
MOST = 64  # suffixes in one fragment
HOT = 20_000
CUT = 16  # low bits of an anchor left out while counting
CELL = 16  # anchors that a row of the count should hold at least
NOBODY = (1 << 63) - 1  # place of a null doc_id
U64 = np.uint64
EMPTY = hashlib.sha256(b"").hexdigest()
TEXTS = "part int, digest binary, text binary, first long"
CELLS = "bucket int, part int, anchors binary, times binary"
ANSWERS = "part int, bucket int, at long, data binary"
FRAGMENTS = "bucket int, part int, at long, first long, several boolean, text binary"
RESULTS = "digest binary, first long, n_removed long, n_spans long, kept_sha256 string"


def _table(columns: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.Table.from_arrays(arrays, names=[name for name, _ in fields])


def spread(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    found, filled = np.ones(n, U64), 1
    while filled < n:
        more = min(filled, n - filled)
        found[filled : filled + more] = found[:more] * U64(pow(base, filled, 1 << 64))
        filled += more
    return found


_kept_powers = lru_cache(maxsize=2)(_powers)  # those of a segment, needed all the time


class PrefixHashes:
    """Polynomial hashes modulo 2^64 of all prefixes of some bytes, each byte under a random number.

    The hash of a substring is the difference of two prefixes, shifted back by a power of the odd base.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 1 << 62, 256, dtype=U64) * U64(4) + U64(1)
        base = int(rng.integers(1 << 40, 1 << 60)) * 8 + 5
        n = len(data)
        powers, room = (_kept_powers, SEGMENT + SPAN) if n <= SEGMENT + SPAN and not seed else (_powers, n + 1)
        self._back = powers(pow(base, -1, 1 << 64), room)
        self._sums = letters[data]
        self._sums *= powers(base, room)[:n]
        self._sums = np.append(U64(0), np.cumsum(self._sums, out=self._sums))

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self._sums[start + length] - self._sums[start]) * self._back[start]

    def all(self, length: int) -> np.ndarray:
        """The hash of every substring of one length."""
        n = len(self._sums) - length
        return (self._sums[length:] - self._sums[:n]) * self._back[:n]


def _pieces(start: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut into pieces of at most so many suffixes: start, size, and the run each comes from."""
    count = -(-size // most)
    which = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return start[which] + number * most, np.minimum(size[which] - number * most, most), which


def anchor_runs(data: np.ndarray, ends: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring suffixes with one anchor: first suffix, number, anchor. ``ends``: where texts end in ``data``."""
    starts, sizes, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for at in range(0, max(len(data) - span + 1, 0), SEGMENT):
        low = spread(PrefixHashes(data[at : at + SEGMENT + span - 1]).all(gram))
        held = 1
        while held < span - gram + 1:  # least of ever more neighbours
            step = min(held, span - gram + 1 - held)
            low = np.minimum(low[:-step], low[step:])
            held += step
        n = len(low)
        near = ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + n + span)]
        short = (near[:, None] - np.arange(1, span)).ravel() - at  # too close to the end of their text
        whole = np.ones(n, bool)
        whole[short[(short >= 0) & (short < n)]] = False
        edge = ~whole
        edge[0] = True
        edge[1:] |= (low[1:] != low[:-1]) | ~whole[:-1]
        begin = np.flatnonzero(edge)
        length = np.diff(begin, append=n)
        begin, length = begin[whole[begin]], length[whole[begin]]
        start, size, which = _pieces(begin, length, MOST)
        starts.append(start + at)
        sizes.append(size)
        anchors.append(spread(low[begin] + U64(1))[which])  # least hashes are small numbers: deal them evenly
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(anchors)


@dataclass(frozen=True)
class Counted:
    """The distinct cut anchors of a chunk, ascending."""

    cut: np.ndarray
    slot: np.ndarray  # of each run
    times: np.ndarray  # runs that have it
    several: np.ndarray  # whether different texts have it


class Chunk:
    """The texts of a chunk in one buffer, ordered by digest so that every pass sees the same places."""

    def __init__(self, rows: pa.Table, span: int, gram: int):
        first: dict[bytes, int] = {}
        texts: dict[bytes, pa.Buffer] = {}
        cells = rows.column("text").combine_chunks()
        for k, (key, low) in enumerate(zip(rows.column("digest").to_pylist(), rows.column("first").to_pylist(), strict=True)):
            first[key] = min(low, first.get(key, NOBODY))
            if key not in texts and (cell := cells[k]).is_valid:
                texts[key] = cell.as_buffer()
        self.digests = sorted(texts)
        self.first = np.array([first[d] for d in self.digests], np.int64)
        self.data = np.frombuffer(b"".join(texts[d] for d in self.digests), np.uint8)
        self.ends = np.cumsum([texts[d].size for d in self.digests], dtype=np.int64)
        self.span = span
        self.start, self.size, self.anchor = anchor_runs(self.data, self.ends, span, gram)

    def counted(self) -> Counted:
        cut, slot, times = np.unique(self.anchor >> U64(CUT), return_inverse=True, return_counts=True)
        text = np.searchsorted(self.ends, self.start, "right")[np.argsort(slot, kind="stable")]
        last = np.cumsum(times)
        return Counted(cut, slot, times, text[last - times] != text[last - 1] if len(cut) else np.zeros(0, bool))

    def fragments(self, answers: pa.Table) -> Fragments:
        """What takes part in the sort, by the answers about the chunk's anchors."""
        known = self.counted()
        order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        cells = answers.column("data").to_pylist()
        said = np.concatenate([np.frombuffer(cells[k], np.uint8) for k in order]) if cells else np.zeros(0, np.uint8)
        hot = (said == 2)[known.slot]
        cool = np.flatnonzero(((said > 0) | known.several)[known.slot] & ~hot)
        hot = np.flatnonzero(hot)
        one, single, _ = _pieces(self.start[hot], self.size[hot], 1)
        start, size = np.concatenate([self.start[cool], one]), np.concatenate([self.size[cool], single])
        dealt = np.concatenate([self.anchor[cool], np.zeros(len(one), U64)])
        for j in range(self.span if len(one) else 0):
            dealt[len(cool) :] = spread(dealt[len(cool) :] * U64(3) + self.data[one + j])
        return Fragments(self, start, size, dealt)


class Fragments:
    """Fragments of a chunk in groups of equal bytes; a group is known by its first place."""

    def __init__(self, chunk: Chunk, start: np.ndarray, size: np.ndarray, dealt: np.ndarray):
        order = np.argsort(start)
        self.start, self.size, self.dealt = start[order], size[order], dealt[order]
        self.first = chunk.first[np.searchsorted(chunk.ends, self.start, "right")]
        until = (self.start + self.size + chunk.span - 1).tolist()
        data = chunk.data.tobytes()  # slices of a memoryview would never be let go by Arrow
        texts = pa.array([data[a:b] for a, b in zip(self.start.tolist(), until, strict=True)], pa.binary())
        coded = texts.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        self.texts = coded.dictionary  # in order of first occurrence, as groups are
        self.order = np.argsort(code, kind="stable")
        self.count = np.bincount(code, minlength=len(self.texts))
        self.heads = np.cumsum(self.count) - self.count

    def __len__(self) -> int:
        return len(self.heads)

    @property
    def at(self) -> np.ndarray:
        return self.start[self.order[self.heads]]


def _sent(chunk: Chunk, part: int, buckets: int) -> pa.Table:
    known = chunk.counted()
    edges = ((np.arange(1, buckets, dtype=object) << (64 - CUT)) // buckets).astype(U64)
    ends = np.concatenate([[0], np.searchsorted(known.cut, edges), [len(known.cut)]])
    rows = []
    for b in np.flatnonzero(np.diff(ends)).tolist():
        lo, hi = ends[b], ends[b + 1]
        steps = np.diff(known.cut[lo:hi], prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        rows.append((b, part, steps.T.tobytes(), np.minimum(known.times[lo:hi], 255).astype(np.uint8).tobytes()))
    return _table(list(zip(*rows, strict=True)) or [[]] * 4, CELLS)


def _answered(cells: pa.Table) -> pa.Table:
    """For each anchor sent: 0 if no other chunk has it, 2 if more than ``HOT`` fragments have it, else 1."""
    anchors, times = [], []
    for steps, count in zip(cells.column("anchors"), cells.column("times"), strict=True):
        flat = np.frombuffer(steps.as_buffer(), np.uint8).reshape(6, -1)
        wide = np.zeros((flat.shape[1], 8), np.uint8)
        wide[:, :6] = flat.T
        anchors.append(np.cumsum(wide.view("<u8").ravel()))
        times.append(np.frombuffer(count.as_buffer(), np.uint8))
    _, slot, chunks = np.unique(np.concatenate(anchors), return_inverse=True, return_counts=True)
    total = np.bincount(slot, np.concatenate(times))
    said = np.where(total > HOT, 2, np.where(chunks > 1, 1, 0)).astype(np.uint8)[slot]
    cuts = np.cumsum([len(a) for a in anchors])[:-1]
    n = len(anchors)
    data = [a.tobytes() for a in np.split(said, cuts)]
    return _table([cells.column("part").to_pylist(), cells.column("bucket").to_pylist(), [None] * n, data], ANSWERS)


def _offered(found: Fragments, part: int, buckets: int) -> pa.Table:
    if not len(found):
        return _table([[]] * 6, FRAGMENTS)
    mine = found.first[found.order]
    low, high = np.minimum.reduceat(mine, found.heads), np.maximum.reduceat(mine, found.heads)
    head = found.order[found.heads]
    bucket = (spread(found.dealt[head]) % U64(buckets)).astype(np.int32)
    return _table([bucket, np.full(len(head), part, np.int32), found.start[head], low, high > low, found.texts], FRAGMENTS)


class SuffixSort:
    """Suffixes of some bytes in the order of their first ``span`` bytes."""

    def __init__(self, data: np.ndarray, span: int, seed: int):
        self.data, self.span = data, span
        self.hashes = PrefixHashes(data, seed)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix, as far as ``span``: binary search over prefix hashes."""
        common = np.zeros(len(a), np.int64)
        step = 1 << (self.span.bit_length() - 1)
        while step:
            longer = common + step
            fits = np.flatnonzero(longer <= self.span)
            same = self.hashes.of(a[fits], longer[fits]) == self.hashes.of(b[fits], longer[fits])
            common[fits[same]] += step
            step >>= 1
        return common

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether a comes before b; for equal ones what ``ties`` says."""
        common = self.extension(a, b)
        open_ = common < self.span
        behind = np.where(open_, common, 0)
        return np.where(open_, self.data[a + behind] < self.data[b + behind], ties)

    def order(self, suffixes: np.ndarray) -> np.ndarray:
        key = np.zeros(len(suffixes), U64)
        for k in range(8):
            key = key << U64(8) | self.data[suffixes + k].astype(U64)
        by_key = np.argsort(key, kind="stable")
        found, key = suffixes[by_key], key[by_key]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(begin, append=len(found))
        width = 1
        while (length > width).any():
            found = self._merged(found, begin[length > width], length[length > width], width)
            width *= 2
        return found

    def _merged(self, found: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
        """Each run's sorted blocks of ``width`` merged in pairs: a place is its own rank and the rank in the other block."""
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        run = np.repeat(begin, length)
        mine, stop = run + inside, run + np.repeat(length, length)
        base = run + inside // (2 * width) * (2 * width)
        middle, last = np.minimum(base + width, stop), np.minimum(base + 2 * width, stop)
        left = mine < middle
        low, high = np.where(left, middle, base), np.where(left, last, middle)
        start = low.copy()
        while len(open_ := np.flatnonzero(low < high)):
            probe = (low[open_] + high[open_]) >> 1
            # Equal ones of the left block stay in front.
            right = self.before(found[probe], found[mine[open_]], ~left[open_])
            low[open_[right]] = probe[right] + 1
            high[open_[~right]] = probe[~right]
        merged = found.copy()
        merged[base + (mine - np.where(left, base, middle)) + (low - start)] = found[mine]
        return merged

    def classes(self, ordered: np.ndarray) -> np.ndarray | None:
        """Where groups of equal suffixes begin; None if the hashes took different bytes for equal."""
        same = self.extension(ordered[:-1], ordered[1:]) == self.span
        a, b = ordered[:-1][same], ordered[1:][same]
        for k in range(self.span):
            if (self.data[a + k] != self.data[b + k]).any():
                return None
        return np.flatnonzero(np.append(True, ~same))


def least_firsts(texts: list[bytes], firsts: np.ndarray, span: int) -> list[np.ndarray]:
    """For every suffix of every text the smallest ``first`` of the texts that have its span somewhere."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    number = sizes - span + 1
    within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    suffixes = np.repeat(np.cumsum(sizes) - sizes, number) + within
    seed, begins = 0, None
    while begins is None:
        seed += 1
        sorter = SuffixSort(data, span, seed)
        ordered = sorter.order(suffixes)
        begins = sorter.classes(ordered)
    owner = np.zeros(len(data), np.int64)
    owner[suffixes] = np.repeat(firsts, number)
    least = np.minimum.reduceat(owner[ordered], begins)
    owner[ordered] = np.repeat(least, np.diff(begins, append=len(ordered)))
    return np.split(owner[suffixes], np.cumsum(number)[:-1])


def _sorted(rows: pa.Table, span: int) -> pa.Table:
    coded = rows.column("text").combine_chunks().dictionary_encode()
    code, first = coded.indices.to_numpy(zero_copy_only=False), rows.column("first").to_numpy()
    lowest = np.full(len(coded.dictionary), NOBODY, np.int64)
    np.minimum.at(lowest, code, first)
    least = least_firsts(coded.dictionary.to_pylist(), lowest, span)
    part, at, data = [], [], []
    several, parts, places = (rows.column(c).to_pylist() for c in ("several", "part", "at"))
    for k, mine in enumerate(code.tolist()):
        values = least[mine]
        if several[k] or (values < first[k]).any():
            part.append(parts[k])
            at.append(places[k])
            data.append((values[:1] if (values == values[0]).all() else values).astype("<i8").tobytes())
    return _table([part, [-1] * len(part), at, data], ANSWERS)


def _removed(chunk: Chunk, found: Fragments, results: pa.Table) -> pa.Table:
    begins = np.zeros(len(chunk.data), np.int8)  # of removed spans
    if results.num_rows:
        group = np.searchsorted(found.at, results.column("at").to_numpy())
        for g, cell in zip(group.tolist(), results.column("data"), strict=True):
            values = np.frombuffer(cell.as_buffer(), "<i8")
            for k in found.order[found.heads[g] : found.heads[g] + found.count[g]].tolist():
                begins[found.start[k] : found.start[k] + found.size[k]] = values < found.first[k]
    rows, at = [], 0
    for digest, first, end in zip(chunk.digests, chunk.first.tolist(), chunk.ends.tolist(), strict=True):
        text, removed, spans = chunk.data[at:end], 0, 0
        if begins[at:end].any():
            so_far = np.cumsum(begins[at:end], dtype=np.int32)
            gone = so_far > 0
            gone[chunk.span :] = so_far[chunk.span :] > so_far[: -chunk.span]
            removed, spans = int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
            text = text[~gone]
        rows.append((digest, first, removed, spans, hashlib.sha256(text.tobytes()).hexdigest()))
        at = end
    return _table(list(zip(*rows, strict=True)) or [[]] * 5, RESULTS)


def _once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once, and the smallest doc_id of each text that came again."""
    least: dict[bytes, int] = {}
    parts: dict[bytes, int] = {}
    for batch in batches:
        keep = []
        for part, key, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep.append(key not in least)
            if not keep[-1]:
                parts[key] = part
            least[key] = min(first, least.get(key, NOBODY))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays(kept.columns, names=kept.schema.names)
    again = list(parts)
    rows = [[parts[k] for k in again], again, [None] * len(again), [least[k] for k in again]]
    yield from _table(rows, TEXTS).to_batches()


def _digest() -> F.Column:
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per distinct text: its digest, smallest doc_id (``first``), and what is removed from the document of that id."""
    mine = documents(docs)
    volume = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-volume // CHUNK_BYTES))
    counting = max(1, min(parts, CHUNK_BYTES * 2 // (span - gram) // CELL))
    sorting = SHARES * parts
    keyed = mine.select(
        F.pmod(F.xxhash64(_digest()), F.lit(parts)).cast("int").alias("part"), _digest().alias("digest"),
        F.col("text").cast("binary").alias("text"), F.coalesce("doc_id", F.lit(NOBODY)).alias("first"),
    )
    chunks = keyed.mapInArrow(_once_a_task, TEXTS).repartition(parts, "part")

    def send(rows: pa.Table) -> pa.Table:
        return released(_sent(Chunk(rows, span, gram), rows.column("part")[0].as_py(), counting))

    def offer(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(rows, span, gram)
        return released(_offered(chunk.fragments(answers), rows.column("part")[0].as_py(), sorting))

    def remove(rows: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(rows, span, gram)
        answer = np.array(told.column("bucket").to_numpy() >= 0, bool)
        return released(_removed(chunk, chunk.fragments(told.filter(pa.array(answer))), told.filter(pa.array(~answer))))

    answers = chunks.groupBy("part").applyInArrow(send, CELLS).groupBy("bucket").applyInArrow(lambda cells: released(_answered(cells)), ANSWERS)
    offered = chunks.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(offer, FRAGMENTS)
    found = offered.groupBy("bucket").applyInArrow(lambda rows: released(_sorted(rows, span)), ANSWERS)
    return chunks.groupBy("part").cogroup(answers.union(found).groupBy("part")).applyInArrow(remove, RESULTS)


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per document: ``n_bytes``, ``n_removed``, ``n_spans`` and the hash of what is kept.

    A later document of a text that an earlier one has loses all of it, if it is as long as the span.
    """
    rows = documents(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _digest().alias("digest"))
    joined = rows.join(without_repeats(docs, span, gram), "digest")
    copy = (F.coalesce("doc_id", F.lit(NOBODY)) > F.col("first")) & (F.col("n_bytes") >= span)
    return joined.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
