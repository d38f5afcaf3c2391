"""History, calendar and category features for forecasting."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.settings import DEFAULTS, Settings

TARGET = "energy_consumption"
# Column order of the feature table and of the model matrix.
BASE_COLUMNS = (
    "timestamp", "meter_id", "meter_type", "region", "energy_consumption", "voltage", "current",
    "power_factor", "temperature", "humidity", "weather_condition", "hour", "day", "month", "year",
    "day_of_week", "weekend_flag", "peak_hour_flag", "season", "temperature_band", "date",
)
NUMERIC = (
    "voltage", "current", "power_factor", "temperature", "humidity", "hour", "day", "month",
    "day_of_week", "weekend_flag", "peak_hour_flag",
)
CATEGORICAL = ("meter_type", "season", "weather_condition")
CYCLES = {"hour": ("hour", 24), "month": ("month", 12), "dow": ("day_of_week", 7)}

SEGMENT_DAYS = 366


def history_names(settings: Settings = DEFAULTS) -> list[str]:
    lags = [f"lag_{k}h" for k in settings.lags]
    return lags + [f"rolling_{stat}_{w}h" for w in settings.rolling_windows for stat in ("mean", "std")]


def _history(order: WindowSpec, settings: Settings, full_frames: bool) -> dict[str, Column]:
    made = {f"lag_{k}h": F.lag(TARGET, k).over(order) for k in settings.lags}
    for width in settings.rolling_windows:
        before = order.rowsBetween(-width, -1)
        for stat, measure in (("mean", F.avg), ("std", F.stddev_samp)):
            value = measure(TARGET).over(before)
            if full_frames:
                value = F.when(F.count(TARGET).over(before) == width, value)
            made[f"rolling_{stat}_{width}h"] = value
    return made


def with_history(
    df: DataFrame,
    settings: Settings = DEFAULTS,
    *,
    names: Sequence[str] | None = None,
    full_frames: bool = False,
    segment_days: int = SEGMENT_DAYS,
) -> DataFrame:
    """Add lags and rolling statistics over the preceding rows of each meter.

    A meter's whole past would make one task grow for ever, so rows are windowed per meter and
    segment of ``segment_days``. Only the first rows of a segment look across its border: they are
    computed again from the border rows of all segments, at most two window depths per segment.
    Both parts read the same shuffle. ``names`` limits the work to some of the columns.
    """
    depth = max(*settings.lags, *settings.rolling_windows)
    segment = F.floor(F.unix_date(F.to_date("timestamp")) / F.lit(segment_days))
    in_segment = Window.partitionBy("meter_id", "_segment").orderBy("timestamp")
    wanted = list(history_names(settings) if names is None else names)

    placed = df.withColumn("_segment", segment).withColumns(
        {
            "_place": F.row_number().over(in_segment),
            "_closing": F.lead("meter_id", depth).over(in_segment).isNull(),
        }
    )

    def computed(rows: DataFrame, order: WindowSpec) -> DataFrame:
        made = _history(order, settings, full_frames)
        return rows.withColumns({name: made[name] for name in wanted})

    inner = computed(placed, in_segment).where(F.col("_place") > depth)
    border = placed.where((F.col("_place") <= depth) | F.col("_closing"))
    opening = computed(border, Window.partitionBy("meter_id").orderBy("timestamp")).where(F.col("_place") <= depth)
    return inner.unionByName(opening).drop("_segment", "_place", "_closing")


def ml_features(silver: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return with_history(silver.select(*BASE_COLUMNS), settings)


def with_missing_history(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add only the history columns that are absent; here a rolling value needs its full frame."""
    absent = [name for name in history_names(settings) if name not in df.columns]
    return with_history(df, settings, names=absent, full_frames=True) if absent else df


def with_cycles(df: DataFrame) -> DataFrame:
    """Sine and cosine of hour, month and day of week, so that the ends of a cycle meet."""
    made = {}
    for prefix, (column, period) in CYCLES.items():
        angle = F.lit(2 * math.pi) * F.col(column) / F.lit(period)
        made[f"{prefix}_sin"], made[f"{prefix}_cos"] = F.sin(angle), F.cos(angle)
    return df.withColumns(made)


def model_rows(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows with complete history, ready for encoding."""
    return with_cycles(with_missing_history(df, settings)).dropna(subset=history_names(settings))


def numeric_columns(settings: Settings = DEFAULTS) -> list[str]:
    cycles = [f"{prefix}_{wave}" for prefix in CYCLES for wave in ("sin", "cos")]
    return [*NUMERIC, *history_names(settings), *cycles]


def aligned(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The rows with every column a model reads: an absent number counts 0.0, an absent category is no known level."""
    numbers = {c: F.lit(0.0) for c in numeric_columns(settings) if c not in df.columns}
    labels = {c: F.lit(None).cast("string") for c in CATEGORICAL if c not in df.columns}
    return df.withColumns(numbers | labels) if numbers or labels else df


def feature_matrix(
    df: DataFrame, levels: Mapping[str, Sequence[str]], settings: Settings = DEFAULTS
) -> DataFrame:
    """Plain-column matrix: key, target, numeric features and one 0/1 column per category level."""
    encoded = [
        F.when(F.col(column) == level, 1.0).otherwise(0.0).alias(f"{column}_{level}")
        for column in CATEGORICAL
        for level in levels[column]
    ]
    numeric = [F.col(c).cast("double").alias(c) for c in numeric_columns(settings)]
    return model_rows(df, settings).select("timestamp", "meter_id", TARGET, *numeric, *encoded)


def category_levels(df: DataFrame) -> dict[str, list[str]]:
    """Distinct values per category, in order; each becomes a column of the plain matrix."""
    sets = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in CATEGORICAL]).first()
    return {c: list(sets[c]) for c in CATEGORICAL}
