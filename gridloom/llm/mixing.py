"""Operator 4: mixing sources to target weights by Poisson replication.

Source s has n_s of N documents and the target share w_s, so each of its documents is wanted
``w_s * size / n_s`` times on average. A uniform number hashed from (seed, doc_id) is put through the
inverse of that Poisson distribution; the document appears so often, and the copies of all sources are
sorted by a second hash, which is a global shuffle. The draw depends on nothing but the document, the
seed and its source's rate: partitions, retries and other documents of the source cannot change it.

Weights are a parameter. Sources without a weight (null among them) share ``other``; shares are scaled to sum
to one over the sources present. The rate of a source is the only thing sent to the tasks, for the sources
the parameter names and one value for the rest, so its size is the parameter's.

Any rate is drawn exactly. Up to ``ONE_DRAW`` one number is put through the inverse; beyond it the first term of the
distribution underflows, so the count is the sum of independent draws of equal rates below that, each from a number of its
own hash. Sums of Poisson counts are Poisson. The expected SQL holds up to that rate; its own first term underflows beyond.

Null doc_id hashes like an empty string. Repeated rows of a document are repeated alike. Texts of any length
are carried along. An empty table stays empty. Other columns pass through; ``copy`` and ``mix_key`` replace
columns of that name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

SEED = "mix-1"
ONE_DRAW = 700.0  # exp(-rate) is still a normal double
COPIES = 4096  # copies of a document numbered by one array
#: Production target: the twenty feeds alike, whatever their size; anything else together counts as one feed.
WEIGHTS = {f"src{k}": 1.0 for k in range(20)}
OTHER = 1.0
DIGITS = 12  # hexadecimal digits of a hash behind one uniform number


def cumulative(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until the double no longer grows."""
    term = total = math.exp(-rate)
    found, k = [total], 0
    while term > 1e-17 or k < rate:
        k += 1
        term *= rate / k
        total += term
        found.append(total)
    return found


def rates(counts: Mapping[str | None, int], weights: Mapping[str, float], other: float, size: float) -> dict:
    """Mean repetitions for each named source present, and under None for all others."""
    named = {s: n for s, n in counts.items() if s in weights and n}
    rest = sum(n for s, n in counts.items() if s not in weights)
    wanted = {s: weights[s] for s in named} | ({None: other} if rest else {})
    whole = sum(wanted.values())
    return {s: w / whole * size / (named[s] if s is not None else rest) for s, w in wanted.items()} if whole else {}


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) hashed from the parts."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _inverse(u: Column, rate: float) -> Column:
    """The inverse of the Poisson distribution at ``u``: how many cumulative values lie at or below it."""
    steps = F.array(*(F.lit(x) for x in cumulative(rate)))
    return F.size(F.filter(steps, lambda x: x <= u))


def _draws(seed: str, rate: float) -> Column:
    """How often a document of that rate appears."""
    if rate <= ONE_DRAW:
        return _inverse(uniform(seed, _id()), rate)
    parts = math.ceil(rate / ONE_DRAW)
    numbers = F.sequence(F.lit(0), F.lit(parts - 1))
    return F.aggregate(
        numbers, F.lit(0), lambda total, k: total + _inverse(uniform(seed, "part", k, _id()), rate / parts)
    )


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    other: float = OTHER,
    epochs: float = 1.0,
    seed: str = SEED,
) -> DataFrame:
    """All copies in shuffled order, with ``copy`` (from 0) and ``mix_key``."""
    named = F.when(F.col("source").isin(list(weights)), F.col("source"))
    counts = {r[0]: r[1] for r in docs.groupBy(named.alias("s")).count().collect()}  # one row a named source
    wanted = rates(counts, weights, other, epochs * sum(counts.values()))
    copies = F.lit(0)
    for source, rate in wanted.items():
        copies = F.when(named.isNull() if source is None else named == source, _draws(seed, rate)).otherwise(copies)
    # Blocks of copies, then the copies of a block: no array grows with the rate.
    drawn = docs.withColumn("__copies", copies).where("__copies > 0")
    blocks = drawn.withColumn("__first", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__copies") - 1, F.lit(0)), F.lit(COPIES))))
    last = F.least(F.col("__first") + COPIES, F.col("__copies")) - 1
    repeated = blocks.withColumn("copy", F.explode(F.sequence("__first", last))).drop("__copies", "__first")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), _id(), F.col("copy").cast("string")))
    return repeated.withColumn("mix_key", key).orderBy("mix_key", "doc_id", "copy")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def expected_sql(relation: str = "documents", weights: Mapping[str, float] = WEIGHTS, other: float = OTHER, seed: str = SEED) -> str:
    """The same rows stated for DuckDB: rates from counts, Poisson terms by recursion, inversion by counting."""
    values = ", ".join(f"('{s}', {w})" for s, w in weights.items())
    hashed = f"md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), ''))"
    return f"""
WITH RECURSIVE weight(source, w) AS (VALUES {values}),
src AS (SELECT d.*, CASE WHEN w.source IS NOT NULL THEN d.source END AS named
        FROM {relation} d LEFT JOIN weight w ON d.source = w.source),
n AS (SELECT named, count(*) AS n FROM src GROUP BY named),
share AS (SELECT n.named, n.n, coalesce(w.w, {other}) AS w FROM n LEFT JOIN weight w ON n.named = w.source),
rate AS (SELECT named, w / (SELECT sum(w) FROM share) * (SELECT CAST(sum(n) AS DOUBLE) FROM share) / n AS rate FROM share),
term(named, rate, k, t, total) AS (
  SELECT named, rate, 0, exp(-rate), exp(-rate) FROM rate
  UNION ALL
  SELECT named, rate, k + 1, t * (rate / (k + 1)), total + t * (rate / (k + 1)) FROM term WHERE t > 1e-17 OR k < rate),
drawn AS (SELECT s.*, CAST(('0x' || substr({hashed}, 1, {DIGITS})) AS BIGINT) / {float(16**DIGITS)!r} AS u FROM src s),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
    (SELECT count(*) FROM term t WHERE t.named IS NOT DISTINCT FROM d.named AND t.total <= d.u) AS copies FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       md5('{seed}:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS mix_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM counted)"""
