"""Operator 2: personal data by bootstrapped contextual extraction.

**Seeds.** Four kinds of entities are found by patterns, leftmost and non-overlapping per kind; those failing their check
(parts of an address at most 255, 16 to 19 digits that pass Luhn, 8 to 15 digits) are dropped. Patterns are written with
possessive quantifiers and look-behind, so that they match the same spans without going back: time stays in proportion to the text.

**Patterns.** The two words before a seed are a lexical pattern for its kind. *Candidates* are tokens with a digit or ``@``, and runs
of tokens with a digit joined by single spaces, that no seed covers. A run with ``RUN_DIGITS`` digits in all is one candidate; its
tokens are then no instances of their own there, but are still found where other places show them. In any other run, each token of
at least ``SHORTEST`` characters is a candidate. Marks at the end of a token end the run, and ``+`` begins another. The words
before are taken from the text, whatever they are. Seeds and candidates are the instances of a bipartite graph with patterns, weighted by nothing but presence.

**Scores.** A pattern's score for a kind is the mean score of its distinct instances, with ``DOUBT`` unknown ones added; it needs
``SUPPORT`` distinct seeds of the kind. A candidate's score is that of its best pattern. Both are computed in turn for ``ROUNDS``
rounds as joins of the edge table; a seed's score stays 1 for its kind and 0 for others.

**Discovery.** Candidates that end at ``CONFIDENCE`` or more are personal data of that kind wherever they occur.

Everything is built-in expressions. Positions come from splitting a text at its matches: gap lengths add up to offsets in code points.

Null or empty text: no spans. Very long texts: whole. Repeated rows: each with its spans; they count once for scores. Null doc_id: like any
other. Ties between kinds: the kind named first. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.llm.common import documents, table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
CANDIDATE = (
    r"(?<!\S)[^\s0-9@]*+(?:[0-9][^\s@]*+(?!\S)(?:(?<=[0-9A-Za-z)\]}-]) [^\s0-9@+]*+[0-9][^\s@]*+(?!\S))*+|[0-9@]\S*+)"
)
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
LAST_WORDS = r"(\S+)\s+(\S+)\s*$"
EDGE_MARKS = r"^[\"'(\[<{]+|[\"')\]>},.;:!?]+$"
RUN_LEAD = r"^[\"'\[<{]*(?:\((?![0-9]+\)))?"  # a bracket stays if it is closed right after its digits
WINDOW = 160  # characters of a gap that its last two words are looked for in
SHORTEST = 6  # characters of a token
RUN_DIGITS = (6, 19)
SUPPORT = 5
DOUBT = 0.5
CONFIDENCE = 0.8
ROUNDS = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    places = F.split(F.reverse(digits), "(?!^)(?=.)")
    doubled = F.transform(
        places,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    return (
        F.when(kind == "ip", value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))
        .when(kind == "card", passes_luhn(digits))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _located(rows: DataFrame, patterns: dict[str, str], needs: dict[str, str]) -> DataFrame:
    """All matches: key, kind, value, start, end, and the text right before each."""
    found = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.when(F.col("text").rlike(needs[kind]), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("values"),
            F.lit(pattern).alias("pattern"),
        )
        for kind, pattern in patterns.items()
    ]
    hits = rows.select("doc_id", "h", "text", F.explode(F.array(*found)).alias("f")).where(F.size("f.values") > 0)
    gaps = [F.when(F.col("f.kind") == kind, F.split("text", pattern, -1)) for kind, pattern in patterns.items()]
    parts = hits.select("doc_id", "h", "f.kind", F.col("f.values").alias("v"), F.coalesce(*gaps).alias("g"))
    zipped = F.arrays_zip("v", F.slice("g", 1, F.size("v")).alias("g"))
    each = parts.select("doc_id", "h", "kind", F.posexplode(zipped).alias("i", "p"))
    each = each.select(
        "doc_id", "h", "kind", "i", F.col("p.v").alias("value"),
        F.length("p.g").cast("long").alias("gap"), F.length("p.v").cast("long").alias("size"),
        F.right("p.g", F.lit(WINDOW)).alias("gap_end"), F.right("p.v", F.lit(WINDOW)).alias("value_end"),
    ).distinct()
    so_far = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    # Two matches back there are two words more, if there are any.
    order = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    old = [F.lag(name, back, "").over(order) for name, back in (("value_end", 2), ("gap_end", 1), ("value_end", 1))]
    each = each.withColumn("before", F.right(F.concat(*old, "gap_end"), F.lit(WINDOW)))
    return each.select("doc_id", "h", "kind", "value", (end - F.col("size")).alias("start"), end.alias("end"), "before")


def _context(before: Column) -> Column:
    """The two words before, without case and marks at their edges; null at the start of a text."""
    words = [F.lower(F.regexp_extract(before, LAST_WORDS, k)) for k in (1, 2)]
    return F.when(words[1] != "", F.concat_ws(" ", *words))


def _candidates(rows: DataFrame) -> DataFrame:
    """Runs that count as one (``run``) and single tokens, with where their run begins (``first``)."""
    found = _located(rows, {"token": CANDIDATE}, {"token": "[0-9@]"}).withColumnRenamed("start", "first")
    one_run = F.col("value").contains(" ") & F.length(_digits(F.col("value"))).between(*RUN_DIGITS)
    runs = found.where(one_run).select("doc_id", "h", "first", "value", F.col("first").alias("start"), "before", F.lit(True).alias("run"))
    each = found.select("doc_id", "h", "first", "before", F.posexplode(F.split("value", " ")).alias("i", "value"))
    by = Window.partitionBy("doc_id", "h", "first").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("at", F.coalesce(F.sum(F.length("value") + 1).over(by), F.lit(0)))
    last = F.row_number().over(Window.partitionBy("doc_id", "h", "first").orderBy("i"))
    two = [F.lag("value", k, "").over(Window.partitionBy("doc_id", "h", "first").orderBy("i")) for k in (2, 1)]
    before = F.when(last == 1, F.col("before")).otherwise(F.right(F.concat_ws(" ", "before", *two, F.lit("")), F.lit(WINDOW)))
    tokens = each.select("doc_id", "h", "first", "value", (F.col("first") + F.col("at")).alias("start"), before.alias("before"), F.lit(False).alias("run"))
    both = tokens.union(runs)
    # Marks at the edges are no part of an identifier, save the bracket of an area code.
    lead = F.when(F.col("run"), F.length(F.regexp_extract("value", RUN_LEAD, 0))).otherwise(F.length(F.regexp_extract("value", r"^[\"'(\[<{]*", 0)))
    bare = F.when(F.col("run"), F.regexp_replace(F.regexp_replace("value", RUN_LEAD, ""), r"[\"'\]>},.;:!?]+$|(?<=[0-9])\)[\"'\]>},.;:!?)]*$", ""))
    bare = bare.otherwise(F.regexp_replace("value", EDGE_MARKS, ""))
    both = both.withColumn("lead", lead).withColumn("bare", bare)
    return both.select(
        "doc_id", "h", "first", "run", F.col("bare").alias("value"), (F.col("start") + F.col("lead")).alias("start"),
        (F.col("start") + F.col("lead") + F.length("bare")).alias("end"), "before",
    ).where(F.length("value") >= SHORTEST)


def _edges(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pattern, instance, and the kind of a seed (null: candidate); one row each, folded before the shuffle."""
    both = seeds.select(_context(F.col("before")).alias("pattern"), F.lower("value").alias("instance"), "kind").union(
        candidates.select(_context(F.col("before")).alias("pattern"), F.lower("value").alias("instance"), F.lit(None).cast("string"))
    )
    return both.where("pattern is not null").distinct()


def _bootstrapped(edges: DataFrame, support: int, confidence: float, rounds: int) -> DataFrame:
    """Candidates found, with their kind and score."""
    seeded = edges.where("kind is not null")
    supported = (
        seeded.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support).select("pattern", "kind")
    )
    supported = stored(supported, "patterns")
    size = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    size = stored(size.join(supported.select("pattern").distinct(), "pattern", "left_semi"), "pattern-sizes")
    certain = stored(
        seeded.groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("sure")).join(supported, ["pattern", "kind"]), "certain"
    )
    open_edges = stored(
        edges.where("kind is null").select("pattern", "instance").join(supported, "pattern"), "candidate-edges"
    )
    scores = None
    for _ in range(rounds):
        patterns = certain
        if scores is not None:
            believed = open_edges.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
            patterns = certain.join(believed, ["pattern", "kind"], "left")
        else:
            patterns = certain.withColumn("more", F.lit(0.0))
        patterns = patterns.join(size, "pattern").select(
            "pattern", "kind", ((F.col("sure") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + DOUBT)).alias("weight")
        )
        scores = stored(
            open_edges.join(stored(patterns, "pattern-scores"), ["pattern", "kind"])
            .groupBy("instance", "kind")
            .agg(F.max("weight").alias("score")),
            "instance-scores",
        )
    rank = F.row_number().over(Window.partitionBy("instance").orderBy(F.desc("score"), F.array_position(F.lit(list(KINDS)), F.col("kind"))))
    return scores.where(F.col("score") >= confidence).withColumn("rank", rank).where("rank = 1").drop("rank")


def personal_data(
    docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS
) -> DataFrame:
    """Spans of every row's text: seeds in ``base``, seeds and discoveries in ``spans``."""
    rows = documents(docs).withColumn("h", F.xxhash64("text"))
    seeds = stored(_located(rows, PATTERNS, NEEDS).where(_valid(F.col("kind"), F.col("value"))), "seeds")
    tokens = _candidates(rows)
    covered = (
        F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.h") == F.col("s.h"))
        & (F.col("t.start") < F.col("s.end")) & (F.col("s.start") < F.col("t.end"))
    )
    open_tokens = tokens.alias("t").join(seeds.alias("s"), covered, "left_anti")
    place = Window.partitionBy("doc_id", "h", "first")
    candidates = stored(open_tokens.withColumn("in_run", F.max("run").over(place)), "candidates")
    instances = candidates.where(F.col("run") | ~F.col("in_run"))
    found = _bootstrapped(stored(_edges(seeds, instances), "edges"), support, confidence, rounds)
    more = candidates.withColumn("instance", F.lower("value")).join(found, "instance")
    more = more.withColumn("whole", F.max("run").over(place)).where(F.col("run") | ~F.col("whole"))
    more = more.select("doc_id", "h", "kind", "start", "end")
    every = seeds.select("doc_id", "h", "kind", "start", "end", F.lit(True).alias("seed")).union(more.withColumn("seed", F.lit(False)))
    order = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    span = F.struct(order.alias("k"), "start", "end", "kind")
    gathered = every.groupBy("doc_id", "h").agg(
        *(F.count(F.when(F.col("seed") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS),
        F.sort_array(F.collect_list(F.when(F.col("seed"), span))).alias("seeds"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )  # one document's spans, never more
    mine = rows.select("doc_id", "h").alias("r")
    joined = mine.join(
        gathered.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.h") == F.col("g.h")), "left"
    )

    def written(spans: str) -> Column:
        each = F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.coalesce(F.array_join(each, ","), F.lit(""))

    return joined.select(
        "r.doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(written("seeds"), 256).alias("base_sha256"), written("spans").alias("spans"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
