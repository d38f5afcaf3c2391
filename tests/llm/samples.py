"""Small document tables with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone light cloud apple engine violet garden winter signal copper meadow harbor ribbon lantern".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) + str(rng.randrange(9)) for _ in range(n))


def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows, near and exact copies."""
    base = prose(1, 60)
    edited = base.split()
    edited[40] = "changed"
    rows = [
        (1, base, "en", "src0", len(base)),
        (2, base.upper(), "en", "src0", len(base)),
        (3, " ".join(edited), "en", "src1", 1),
        (4, None, None, None, None),
        (5, "", "de", "src2", 0),
        (6, " \t\n", "de", "src2", 3),
        (7, "two words", "fr", "src3", 9),
        (8, "Two  Words", "fr", "src3", 10),
        (9, prose(2, 30_000), "en", "src0", None),
        (10, "é" * 50_000, "fr", "src4", 50_000),
        (11, "Ärger É x y \x0bz", "de", "src5", 5),
        (12, prose(3, 25), "en", "src0", 1),
        (12, prose(3, 25), "en", "src0", 1),
        (12, prose(4, 25), "en", "src9", 2),
        (None, prose(5, 9), "en", "src0", 2),
    ]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def with_clashing(df):
    """Columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("key", "normal", "h", "part", "node", "kept", "bucket", "score", "kind", "value", "copy", "mix_key", "place", "number", "n")
    return df.withColumns({name: F.lit("mine") for name in names})
