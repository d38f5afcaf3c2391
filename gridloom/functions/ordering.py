"""Running totals over a total order, and medians, without gathering a group or an order in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.shared import stored


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    name: str,
    *,
    within: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """Add ``name`` = sum of ``weight`` (default 1: a row number) up to and including each row.

    ``within`` + ``order`` must identify a row. Range partitioning by both cuts the order into
    slots, as many as the session has shuffle partitions, so a group holding most rows also gets
    most slots. The slots are written once; slot totals give each slot its offset, and only rows of
    one slot are sorted together. Where the order is cut decides the balance, never the result.
    """
    weight = F.lit(1) if weight is None else weight
    within = list(within)
    keyed = df.withColumn("_key", F.struct(*within, *[c.alias(f"_o{i}") for i, c in enumerate(order)]))
    slotted = stored(keyed.repartitionByRange("_key").withColumn("_slot", F.spark_partition_id()), "slots")

    earlier = Window.partitionBy(*within).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(*within, "_slot")
        .agg(F.sum(weight).alias("_slot_total"))
        .withColumn("_before", F.coalesce(F.sum("_slot_total").over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_slot").alias("_s"), "_before")
    )
    same_slot = F.col("_slot") == F.col("_s")
    for i, column in enumerate(within):
        same_slot = same_slot & F.col(column).eqNullSafe(F.col(f"_w{i}"))
    inside = (
        Window.partitionBy(*within, "_slot")
        .orderBy("_key")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    helpers = ["_key", "_slot", "_s", "_before", "_run", *[f"_w{i}" for i in range(len(within))]]
    return (
        slotted.withColumn("_run", F.sum(weight).over(inside))
        .join(offsets, same_slot)
        .withColumn(name, F.col("_before") + F.col("_run"))
        .drop(*helpers)
    )


LARGEST = 100_000  # values of a group that one task may order
SPLITS = 4096  # ranges a larger group is counted in, round by round


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str, *, largest: int = LARGEST, splits: int = SPLITS
) -> DataFrame:
    """Exact median per key; ``df`` is read several times, so it should be stored.

    Groups of up to ``largest`` values go to Spark's exact percentile. A larger group is narrowed down first: its values
    are counted in ``splits`` equal ranges between its smallest and largest value, and only the ranges that hold the middle
    are kept, until few values or one value are left. The range of a value never falls as the value grows, so
    counts decide exactly; nothing is sorted or sampled, and no task sees more of a group than counts. Rounds grow with the
    logarithm of how uneven the values are: readings take one or two. Values must be finite.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    large = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    ).where(F.col("_n") > largest)
    state = stored(
        large.select(*keys, "_lo", "_hi", F.expr("(_n + 1) div 2").alias("_first"), F.expr("_n div 2 + 1").alias("_second"), "_n"),
        "large-groups",
    )
    found = [_small_medians(rows, state, keys, name)] if state.take(1) else [_percentile(rows, keys, name)]
    inside = rows
    while state.take(1):
        inside, state = _narrowed(inside, state, keys, splits)
        found.append(state.where("_median IS NOT NULL").select(*keys, F.col("_median").alias(name)))
        state = state.where("_median IS NULL")
        found.append(_middle(inside, state.where(F.col("_n") <= largest), keys, name))
        state = state.where(F.col("_n") > largest)
    return reduce(DataFrame.union, found)


def _percentile(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.percentile("_v", F.lit(0.5)).alias(name))


def _same(keys: Sequence[str], other: str) -> Column:
    return reduce(Column.__and__, (F.col(f"r.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys))


def _small_medians(rows: DataFrame, large: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return _percentile(rows.alias("r").join(large.alias("s"), _same(keys, "s"), "left_anti"), keys, name)


def _narrowed(rows: DataFrame, state: DataFrame, keys: Sequence[str], splits: int) -> tuple[DataFrame, DataFrame]:
    """The values in the ranges that hold the two middle ranks, and the groups with ranks counted among these."""
    width = F.col("_hi") / splits - F.col("_lo") / splits  # no overflow at the ends of double
    place = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / F.nullif(width / 2, F.lit(0.0))), F.lit(splits - 1))
    # The largest value always has the last range, so that every round leaves one value out.
    place = F.when(F.col("_v") == F.col("_hi"), splits - 1).otherwise(F.coalesce(F.least(place, F.lit(splits - 2)), F.lit(0)))
    joined = rows.alias("r").join(state.alias("s"), _same(keys, "s"))
    placed = joined.select(*(F.col(f"r.{k}").alias(k) for k in keys), "_v", place.cast("int").alias("_place"))
    counted = placed.groupBy(*keys, "_place").agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # at most ``splits`` rows
    counted = counted.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    held = counted.alias("r").join(state.alias("s"), _same(keys, "s")).where(
        ((F.col("_before") < F.col("_first")) & (F.col("_first") <= F.col("_before") + F.col("_c")))
        | ((F.col("_before") < F.col("_second")) & (F.col("_second") <= F.col("_before") + F.col("_c")))
    )
    held = stored(
        held.select(*(F.col(f"r.{k}").alias(k) for k in keys), "_place", "_c", "_low", "_high", "_before", "_first", "_second"), "held"
    )
    kept = placed.alias("r").join(
        held.alias("t"), _same(keys, "t") & (F.col("r._place") == F.col("t._place")), "left_semi"
    ).select(*keys, "_v")
    skipped = F.min("_before")
    # Middle ranks in two ranges are the last value of the one and the first of the other.
    apart = F.when(F.count("*") == 2, F.min("_high") / 2 + F.max("_low") / 2)
    alike = F.when(F.min("_low") == F.max("_high"), F.min("_low"))
    following = held.groupBy(*keys).agg(
        F.coalesce(apart, alike).alias("_median"),
        F.min("_low").alias("_lo"), F.max("_high").alias("_hi"), (F.min("_first") - skipped).alias("_first"),
        (F.min("_second") - skipped).alias("_second"), F.sum("_c").alias("_n"),
    )
    return stored(kept, "narrowed"), stored(following, "large-groups")


def _middle(rows: DataFrame, done: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Medians of groups that are down to few values."""
    mine = rows.alias("r").join(done.alias("s"), _same(keys, "s"))
    few = mine.groupBy(*(F.col(f"r.{k}").alias(k) for k in keys)).agg(
        F.array_sort(F.collect_list("_v")).alias("_a"), F.first("_first").alias("_f"), F.first("_second").alias("_s")
    )
    median = F.element_at("_a", F.col("_f").cast("int")) / 2 + F.element_at("_a", F.col("_s").cast("int")) / 2
    return few.select(*keys, median.alias(name))
