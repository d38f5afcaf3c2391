"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.shared import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """For each u the smallest of u and its neighbours; stored, so that a hub's join can be split."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "low")


def _large_star(edges: DataFrame) -> DataFrame:
    both = stored(edges.union(edges.select("v", "u")), "both")
    moved = both.join(_smallest(both), "u").where("v > u")
    return moved.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    kept = stored(edges, "downward")
    low = _smallest(kept)
    moved = kept.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).where("u != v").distinct()


def _signature(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of an edge (columns ``u``, ``v``).

    The stars end when every edge points at a root; the number of rounds grows with the logarithm of the
    longest path. Every round writes its edges to the shared folder, so a lost executor costs one round at most.
    """
    links = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, "links")
    before = _signature(links)
    while before[0]:
        links = stored(_small_star(_large_star(links)), "links")
        after = _signature(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
