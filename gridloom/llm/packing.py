"""Operator 9: packing documents into training sequences by cutting-stock column generation.

A document of n ids is cut into pieces of the full sequence length and one rest. Full pieces are sequences by
themselves; the rests are the stock-cutting problem. Only their length histogram (at most ``LENGTH / UNIT`` numbers at
any input size) reaches the driver, where

* a linear program over cutting patterns is solved by the revised simplex method; its columns are found one at
  a time by greedy filling and a knapsack dynamic program over the current dual prices, until no pattern can improve the bound by
  more than ``GAP``;
* the optimal counts are rounded down, and what is left over is packed first-fit decreasing.

The patterns are then assigned to ranked documents in tasks: the rank of a rest within its length class (its
position in the writing task plus the classes' counts in earlier tasks) says which copy of which pattern it fills.

Lengths are rounded up to ``UNIT`` ids only while planning; the offsets in a sequence are sums of true lengths, so there
are no gaps. Padding stands at the end of a sequence alone.

Null or empty text: one piece with the end id. Very long texts: many pieces. Repeated rows: packed once each. Ties in
length are ranked by their place in the task. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.llm.common import documents, freeing, table
from gridloom.llm.word_encoder import default_tokenizer, encoder

LENGTH = 4096
UNIT = 8
END_ID = 2
GAP = 2e-3
CLEAR = 1.02  # price of a greedy pattern worth taking without a knapsack
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, class int, place long"


def cut_pieces(docs: DataFrame, tokenizer: str | None, end_id: int, length: int, unit: int) -> DataFrame:
    """One row a piece: class 0 holds full pieces, class c the rests of up to c units."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(length // unit + 1, np.int64)
        tail = np.array([end_id], "<u4")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, ids, ends in encoder(path).encode(batch.column(1)):
                rows = []
                for k in range(len(ends) - 1):
                    whole = np.concatenate([ids[ends[k] : ends[k + 1]], tail]).astype("<u4", copy=False)
                    for start in range(0, len(whole), length):
                        part = whole[start : start + length]
                        kind = 0 if len(part) == length else -(-len(part) // unit)
                        crc = zlib.crc32(part.tobytes())
                        rows.append((keys[first + k], start, len(part), crc, len(whole), task, kind, int(seen[kind])))
                        seen[kind] += 1
                types = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    names=[f.split()[0] for f in PIECES.split(", ")],
                )

    return documents(docs).mapInArrow(cut, PIECES)


def best_pattern(price: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of highest price that fits: unbounded knapsack by dynamic programming over the room."""
    best, chosen = np.zeros(room + 1), np.full(room + 1, -1)
    for space in range(1, room + 1):
        fits = np.searchsorted(size, space, "right")  # sizes ascend
        if fits:
            value = best[space - size[:fits]] + price[:fits]
            k = int(value.argmax())
            if value[k] > 1e-12:
                best[space], chosen[space] = value[k], k
        if best[space] < best[space - 1]:
            best[space], chosen[space] = best[space - 1], -2
    pattern, space = np.zeros(len(size)), room
    while space > 0 and chosen[space] != -1:
        if chosen[space] == -2:
            space -= 1
        else:
            pattern[chosen[space]] += 1
            space -= size[chosen[space]]
    return float(best[room]), pattern


def quick_pattern(price: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """A good pattern at once: classes by price per unit, each as often as it still fits."""
    order = np.argsort(-price / size, kind="stable")
    sorted_sizes, pattern, value, at = size[order], np.zeros(len(size)), 0.0, 0
    while room and at < len(order):
        fits = sorted_sizes[at:] <= room
        at += int(fits.argmax())
        kind = order[at]
        if not fits.any() or price[kind] <= 0:
            break
        times = room // size[kind]
        pattern[kind] += times
        value += times * float(price[kind])
        room -= int(times * size[kind])
        at += 1
    return value, pattern


def column_generation(size: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is wanted, as a fraction, so that the demand is met with few sequences.

    Revised simplex on: minimise the sum of counts, patterns times counts = demand. The first basis cuts each
    class alone. A greedy pattern is tried first; the knapsack decides when it finds no clear gain. Two bounds end the
    search: the volume of the demand, and counts divided by the best price of a pattern; neither is above the optimum.
    """
    volume = float(size @ demand) / room
    basis = np.diag(room // size).astype(float)
    inverse, count = np.diag(1 / basis.diagonal()), demand / basis.diagonal()
    for _ in range(50 * len(size)):
        price = inverse.sum(axis=0)
        value, pattern = quick_pattern(price, size, room)
        if value <= CLEAR:
            value, pattern = best_pattern(price, size, room)
            if value <= 1 + gap:
                break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, count / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(ratio.argmin())
        count = np.maximum(count - ratio[leaves] * step, 0)
        count[leaves] = ratio[leaves]
        inverse[leaves] /= step[leaves]
        others = np.arange(len(size)) != leaves
        inverse[others] -= np.outer(step[others], inverse[leaves])
        basis[:, leaves] = pattern
        if count.sum() <= volume * (1 + gap):
            break
    return basis.T, count


def first_fit(size: np.ndarray, demand: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns for what rounding leaves over, largest first, each into the first sequence with room."""
    made: list[np.ndarray] = []
    free: list[int] = []
    for k in np.argsort(-size, kind="stable"):
        need, at = int(demand[k]), 0
        while need:
            while at < len(free) and free[at] < size[k]:
                at += 1
            if at == len(free):
                made.append(np.zeros(len(size), np.int64))
                free.append(room)
            n = min(need, free[at] // int(size[k]))
            made[at][k] += n
            free[at] -= n * int(size[k])
            need -= n
    return made


@dataclass(frozen=True)
class Plan:
    """For each class, ascending first ranks of the runs that a pattern's copies take, and where they lie."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # rank, first sequence, each, first slot
    sequences: int


def plan(histogram: dict[int, int], length: int = LENGTH, unit: int = UNIT, gap: float = GAP) -> Plan:
    classes = np.array(sorted(k for k, n in histogram.items() if k > 0 and n), np.int64)
    if not len(classes):
        return Plan({}, 0)
    demand, room = np.array([histogram[k] for k in classes], np.int64), length // unit
    patterns, counts = column_generation(classes, demand.astype(float), room, gap)
    left, chosen = demand.copy(), []
    for pattern, times in zip(patterns.astype(np.int64), np.floor(counts + 1e-9).astype(np.int64), strict=True):
        used = pattern > 0
        times = min(int(times), int((left[used] // pattern[used]).min())) if used.any() else 0
        if times:
            chosen.append((pattern, times))
            left -= times * pattern
    chosen += [(pattern, 1) for pattern in first_fit(classes, left, room)]
    runs: dict[int, list[tuple[int, int, int, int]]] = {int(k): [] for k in classes}
    rank, sequence = dict.fromkeys(runs, 0), 0
    for pattern, times in chosen:
        slot = 0
        for k in np.nonzero(pattern)[0][::-1]:
            kind, each = int(classes[k]), int(pattern[k])
            runs[kind].append((rank[kind], sequence, each, slot))
            rank[kind] += each * times
            slot += each
        sequence += times
    return Plan({k: tuple(np.array(c) for c in zip(*v, strict=True)) for k, v in runs.items()}, sequence)


def _placed(kinds: np.ndarray, ranks: np.ndarray, made: Plan) -> tuple[np.ndarray, np.ndarray]:
    sequence, slot = made.sequences + ranks, np.zeros_like(ranks)  # class 0: sequences of their own, behind the others
    for kind in np.unique(kinds[kinds > 0]):
        mine = kinds == kind
        first, start, each, at = made.runs[int(kind)]
        run = np.searchsorted(first, ranks[mine], "right") - 1
        within = ranks[mine] - first[run]
        sequence[mine], slot[mine] = start[run] + within // each[run], at[run] + within % each[run]
    return sequence, slot


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    length: int = LENGTH,
    unit: int = UNIT,
    gap: float = GAP,
) -> DataFrame:
    if length % unit or not math.log2(length).is_integer():
        raise ValueError("the length must be a power of two and a multiple of the unit")
    pieces = stored(cut_pieces(docs, tokenizer, end_id, length, unit), "pieces")
    held = pieces.groupBy("task", "class").agg(F.count("*").alias("n"))
    histogram: Sequence = held.groupBy("class").agg(F.sum("n")).collect()  # at most length / unit + 1 rows
    made = plan({r[0]: r[1] for r in histogram}, length, unit, gap)
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("task", "class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    @freeing
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, slot = _placed(frame["class"].to_numpy(), frame["rank"].to_numpy(), made)
            yield frame.drop(columns=["class", "rank"]).assign(sequence_id=sequence, slot=slot)

    ranked = pieces.join(bases, ["task", "class"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("base") + F.col("place")).alias("rank")
    )
    placed = ranked.mapInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
