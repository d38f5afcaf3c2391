"""From raw documents to packed training sequences, one operator a stage.

    toxicity      documents predicted toxic go
    exact dedup   of equal texts the row with the largest doc_id stays
    near dedup    of documents linked by n-gram Jaccard similarity the one with the smallest doc_id stays
    mixing        sources are repeated or thinned out to their target weights, in shuffled order
    packing       what is left is cut and packed into sequences; a row a piece

Every stage reads what the stage before it has written, and all but the last return the columns of ``documents``. What a stage
does with nulls, empty and long texts, ties, repeated rows and other columns is stated by its operator. An empty table
passes every stage empty. Toxicity is a trained model and tokens come from a library, so the whole has no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.functions.shared import stored
from gridloom.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from gridloom.llm.common import table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_duplicates(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_group(docs)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean),
    ("exact dedup", distinct),
    ("near dedup", dissimilar),
    ("mixing", weighted),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
