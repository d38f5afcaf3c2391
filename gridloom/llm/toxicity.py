"""Operator 5: toxicity by weak supervision.

1. **Lexicon.** From a bounded sample of labelled documents (``SAMPLE`` rows, chosen by hash), words and word
   beginnings are counted with and without the label; terms far more frequent in toxic documents enter the lexicon.
2. **Voters.** The lexicon is dealt by hash into several word lists and several lists of beginnings, which
   vote independently of each other; patterns vote too (several hits, two hits close together, a dense text). Each voter says toxic or
   abstains.
3. **Label model.** Votes of *all* documents are counted by pattern. Expectation maximisation estimates the share of toxic
   documents and for each voter how often it fires on either side; gold labels of training rows, where there are any, fix
   their rows. Correlation of voters within a class is then measured, and a voter's evidence is divided by how
   much of it other voters repeat.
4. **Classifier.** A logistic regression on lexicon terms and counts learns the posterior labels of the sample; its score
   is the result. It generalises over single terms, which voters as a whole cannot.

Only rows whose crc32(doc_id as text) mod 4 is not 2 lend labels. Inputs of a score are the text alone.

Null or empty text: scored like a text without any term. Very long texts: whole; a term counts once a document. Null doc_id: held
out never, label unknown. Repeated rows and ties: scored alike. No usable labels: one low score for
all. Empty table: no rows. Other columns are ignored and passed through by ``without_toxic``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.llm.common import documents, freeing, table
from gridloom.llm.word_encoder import slices

SAMPLE = 40_000  # labelled documents that lexicon and classifier learn from, at most about
HELD_OUT = 2
THRESHOLD = 0.3
GOLD = 0.97
UNKNOWN = -2.0  # score of everything, as log odds, where no label is usable
SUPPORT = 5  # toxic documents of the sample that a term needs
MARGIN = 30  # how much likelier a term is in toxic documents than in others
BEGINNINGS = (4, 5, 6)
WORD_LISTS, BEGINNING_LISTS = 4, 3
VOTERS = WORD_LISTS + BEGINNING_LISTS + 3
STRIP = ".,;:!?\"'()[]{}<>|*#$%&_-=+/\\~`"
COUNTS = "term string, toxic long, clean long"


@dataclass(frozen=True)
class Model:
    terms: dict[str, int]  # term -> its place among the weights
    weights: np.ndarray
    extra: np.ndarray  # weights of the voters
    bias: float


def terms_of(word: str) -> list[str]:
    """The terms a word stands for: itself and its beginnings."""
    found = ["w:" + word] if len(word) > 2 else []
    return found + [f"b{n}:" + word[:n] for n in BEGINNINGS if len(word) > n]


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word numbers of all documents, the distinct words behind them, and where each document's begin."""
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    ends = words.offsets.to_numpy().astype(np.int64)
    coded = pc.utf8_trim(words.flatten(), STRIP).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), ends - ends[0]


def _per_document(texts: pa.Array, places: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each document: term places, position of each in the text, words hit at those, and the number of words."""
    for _, part in slices(texts, 6 << 20):
        numbers, distinct, ends = split_words(part)
        hits = [[places[t] for t in terms_of(w) if t in places] for w in distinct]
        size = np.fromiter(map(len, hits), np.int64, len(hits))
        flat = np.fromiter((h for one in hits for h in one), np.int64, int(size.sum()))
        first = np.cumsum(size) - size
        hit = np.nonzero(size[numbers])[0] if len(numbers) else np.zeros(0, np.int64)
        cut = np.searchsorted(hit, ends)
        for k in range(len(ends) - 1):
            at = hit[cut[k] : cut[k + 1]]
            here = numbers[at]
            n = size[here]
            source = np.repeat(first[here] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield flat[source], np.repeat(at, n), here, int(ends[k + 1] - ends[k])


def term_list(term: str) -> int:
    """The word list or list of beginnings that a term of the lexicon belongs to."""
    if term.startswith("w:"):
        return zlib.crc32(term.encode()) % WORD_LISTS
    return WORD_LISTS + int(term[1]) % BEGINNING_LISTS


def _votes(lists: np.ndarray, terms: np.ndarray, at: np.ndarray, words: np.ndarray, n: int) -> int:
    """The voters that say toxic, as bits."""
    bits = int(np.bitwise_or.reduce(np.left_shift(1, lists[terms]))) if len(terms) else 0
    spots = np.unique(at)
    rules = (
        len(np.unique(words)) >= 2,
        len(spots) >= 2 and int(np.diff(spots).min()) <= 12,
        len(spots) >= 1 and 50 * len(spots) >= n,
    )
    return bits | sum(rule << (WORD_LISTS + BEGINNING_LISTS + k) for k, rule in enumerate(rules))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled documents outside the held-out quarter, at most about ``sample``, chosen by hash."""
    gold = labels.select("doc_id", "toxic").where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    gold = gold.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = gold.count()
    share = min(1.0, sample / known) if known else 1.0
    drawn = gold.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # At most about ``sample`` pairs of numbers: they go to the documents, which stay where they are.
    return documents(docs).join(F.broadcast(stored(drawn, "toxicity-sample")), "doc_id")


def held_out(key):
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def _term_counts(sample: DataFrame) -> DataFrame:
    @freeing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            done = 0
            for _, part in slices(batch.column(0), 6 << 20):
                numbers, distinct, ends = split_words(part)
                of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                names = [terms_of(w) for w in distinct]
                place: dict[str, int] = {}
                ids = [[place.setdefault(t, len(place)) for t in one] for one in names]
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for one in ids for i in one), np.int64, int(size.sum()))
                first = np.cumsum(size) - size
                n = size[numbers]
                term = flat[np.repeat(first[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                pairs = np.unique(term * np.int64(len(part) + 1) + np.repeat(of, n))  # a term once a document
                term, row = pairs // (len(part) + 1), pairs % (len(part) + 1)
                label = toxic[done + row]
                hits = np.bincount(term, label, len(place)).astype(np.int64)
                every = np.bincount(term, minlength=len(place))
                done += len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(place), pa.string()), pa.array(hits), pa.array(every - hits)],
                    names=["term", "toxic", "clean"],
                )

    return sample.select("text", "toxic").mapInArrow(count, COUNTS)


def lexicon(sample: DataFrame, support: int = SUPPORT) -> dict[str, int]:
    """Terms ``MARGIN`` times as likely in toxic documents, by more than chance explains, and their places.

    Every term needs ``support`` toxic documents of the sample, so the sample's bound is the lexicon's.
    """
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return {}
    totals = _term_counts(sample).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = (F.col("toxic") + 0.5) / (toxic + 1)
    other = (F.col("clean") + 0.5) / (clean + 1)
    both = (F.col("toxic") + F.col("clean") + 1) / F.lit(float(toxic + clean + 2))
    z = (share - other) / F.sqrt(both * (1 - both) * (1 / (toxic + 1) + 1 / (clean + 1)))
    found = totals.where((F.col("toxic") >= support) & (share > MARGIN * other) & (z > 5)).select("term").collect()
    return {t: k for k, t in enumerate(sorted(r[0] for r in found))}


def _vote_counts(docs: DataFrame, places: dict[str, int]) -> list:
    """How many documents of the whole table show each pattern of votes."""
    lists = np.array([term_list(t) for t in places], np.int64)

    @freeing
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_votes(lists, *hits) for hits in _per_document(batch.column(0), places)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["votes"])

    return docs.select("text").mapInArrow(vote, "votes int").groupBy("votes").count().collect()


@dataclass(frozen=True)
class LabelModel:
    """Share of toxic documents, firing rates of the voters on both sides, and the evidence each adds."""

    share: float
    toxic: np.ndarray
    clean: np.ndarray
    discount: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired = np.log(self.toxic / self.clean)
        silent = np.log((1 - self.toxic) / (1 - self.clean))
        logit = np.log(self.share / (1 - self.share)) + (votes * fired + (1 - votes) * silent) @ self.discount
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def label_model(votes: np.ndarray, counts: np.ndarray, start: LabelModel, gold: tuple[np.ndarray, np.ndarray], rounds: int = 40) -> LabelModel:
    """Expectation maximisation over vote patterns (rows of 0 and 1), then discounts for correlated voters.

    ``gold`` holds, per pattern, the numbers of labelled toxic and clean documents; their class is not estimated.
    """
    model, (sure, unsure) = start, gold
    free = np.maximum(counts - sure - unsure, 0)
    for _ in range(rounds):
        p = model.posterior(votes)
        weight = free * p + sure, free * (1 - p) + unsure
        rates = [(votes.T @ w + 0.5) / (w.sum() + 1) for w in weight]
        share = float((weight[0].sum() + 1) / (counts.sum() + 2))
        model = LabelModel(share, *(np.clip(r, 1e-4, 1 - 1e-4) for r in rates), _discounts(votes, weight))
    return model


def _discounts(votes: np.ndarray, weight: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One over how many voters tell the same within a class: 1 for an independent voter."""
    repeated = np.ones(votes.shape[1])
    for w in weight:
        total = w.sum() + 1e-9
        mean = votes.T @ w / total
        cover = (votes * w[:, None]).T @ votes / total - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cover), 1e-9))
        correlation = np.clip(cover / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(correlation, 0)
        repeated += correlation.sum(axis=1) / 2
    return 1 / repeated


def _bits(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(VOTERS) & 1).astype(float)


def _fit(
    rows: list[tuple[list[int], int]], target: np.ndarray, count: np.ndarray, terms: int, rounds: int = 300
) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by gradient steps with momentum on sparse rows (term places, votes), each held ``count`` times."""
    index = np.fromiter((t for r, _ in rows for t in r), np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r, _ in rows])
    votes = _bits(np.array([v for _, v in rows], np.int64))
    total = count.sum()
    mean = min(max(float(target @ count / total), 1e-3), 1 - 1e-3)
    w, v, b = np.zeros(terms), np.zeros(VOTERS), float(np.log(mean / (1 - mean)))
    moved = [np.zeros(terms), np.zeros(VOTERS), 0.0]
    for _ in range(rounds):
        logit = b + votes @ v + np.bincount(of, w[index], len(rows))
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) * count / total
        slope = (np.bincount(index, error[of], terms) + 1e-5 * w, votes.T @ error + 1e-5 * v, error.sum())
        moved = [0.9 * m - g for m, g in zip(moved, slope, strict=True)]
        w, v, b = w + 4 * moved[0], v + moved[1], b + moved[2]
    return w, v, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, support: int = SUPPORT) -> Model:
    """The classifier; what reaches the driver is bounded by the sample and by the number of vote patterns."""
    mine = documents(docs)
    rows = training_rows(docs, labels, sample)
    places = lexicon(rows, support)
    lists = np.array([term_list(t) for t in places], np.int64)

    @freeing
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_per_document(batch.column(0), places))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([np.unique(h[0]) for h in found], pa.list_(pa.int64())),
                    pa.array([_votes(lists, *h) for h in found], pa.int32()),
                    batch.column(1),
                ],
                names=["terms", "votes", "toxic"],
            )

    learnt = rows.select("text", F.col("toxic").cast("int")).mapInArrow(features, "terms array<long>, votes int, toxic int")
    # Documents with the same terms differ in nothing else: their number is enough.
    held = learnt.groupBy("terms", "votes", "toxic").count().orderBy("terms", "votes", "toxic").collect()
    if not held:
        return Model({}, np.zeros(0), np.zeros(VOTERS), UNKNOWN)
    shown = _vote_counts(mine, places)
    patterns = np.array(sorted({r["votes"] for r in shown} | {r["votes"] for r in held}), np.int64)
    at = {int(p): k for k, p in enumerate(patterns)}
    counts, sure, unsure = (np.zeros(len(patterns)) for _ in range(3))
    for r in shown:
        counts[at[r["votes"]]] += r["count"]
    for r in held:
        (sure if r["toxic"] else unsure)[at[r["votes"]]] += r["count"]
    votes, known = _bits(patterns), sure.sum() + unsure.sum()
    begin = LabelModel(
        float((sure.sum() + 1) / (known + 2)),
        *(np.clip((votes.T @ w + 0.5) / (w.sum() + 1), 1e-4, 1 - 1e-4) for w in (sure, unsure)),
        np.ones(VOTERS),
    )
    model = label_model(votes, np.maximum(counts, sure + unsure), begin, (sure, unsure))
    believed = model.posterior(votes)[[at[r["votes"]] for r in held]]
    # A gold label is one more voter, right GOLD of the time.
    odds = believed / (1 - believed) * np.where([r["toxic"] for r in held], GOLD / (1 - GOLD), (1 - GOLD) / GOLD)
    count = np.array([r["count"] for r in held], float)
    return Model(places, *_fit([(r["terms"], r["votes"]) for r in held], odds / (1 + odds), count, len(places)))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    lists = np.array([term_list(t) for t in model.terms], np.int64)
    logits = []
    for hits in _per_document(texts, model.terms):
        votes = _bits(np.array([_votes(lists, *hits)], np.int64))[0]
        logits.append(model.bias + float(model.weights[np.unique(hits[0])].sum()) + float(votes @ model.extra))
    return 1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30)))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""

    @freeing
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = pa.array(scores(batch.column(1), model))
            yield pa.RecordBatch.from_arrays([batch.column(0), value], names=["doc_id", "score"])

    mine = documents(docs)
    kind = mine.schema["doc_id"].dataType.simpleString()
    return mine.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows not predicted toxic, with all their columns; they are filtered where they are."""
    model = train(docs, labels)

    @freeing
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.coalesce(batch.column("text"), pa.scalar("", batch.column("text").type))
            yield batch.filter(pa.array(scores(texts, model) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
