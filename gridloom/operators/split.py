"""Chronological train/test split."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ordering import running_total


class Boundary(NamedTuple):
    """Training rows lie before ``at``, or at ``at`` with a meter up to ``last_meter``."""

    train_rows: int
    test_rows: int
    at: dt.datetime | None
    last_meter: str | None

    def in_training(self) -> Column:
        if self.at is None:
            return F.lit(True)
        before = F.col("timestamp") < F.lit(self.at)
        if self.last_meter is None:
            return before
        return before | ((F.col("timestamp") == F.lit(self.at)) & (F.col("meter_id") <= self.last_meter))


def find_boundary(df: DataFrame, test_size: float) -> Boundary:
    """Cut the order (timestamp, meter) at ``int(n * (1 - test_size))`` rows.

    Counting narrows the cut down: rows per day first, rows per second of one day next, then the
    rows of one second in order. The driver sees one number per day and at most one per second of
    a day, however many rows there are.
    """
    when = F.col("timestamp")
    days = _counts(df, F.to_date(when))
    size = sum(rows for _, rows in days)
    cut = int(size * (1 - test_size))
    day, left = _reach(days, cut)
    if day is None:
        return Boundary(cut, size - cut, None, None)
    inside = df.where((when >= F.lit(day)) & (when < F.lit(day + dt.timedelta(days=1))))
    second, left = _reach(_counts(inside, F.date_trunc("second", when)), left)
    if not left:
        return Boundary(cut, size - cut, second, None)
    there = inside.where((when >= F.lit(second)) & (when < F.lit(second + dt.timedelta(seconds=1))))
    return Boundary(cut, size - cut, *_nth_row(there, left))


def _counts(df: DataFrame, key: Column) -> list[tuple]:
    return sorted(tuple(row) for row in df.groupBy(key.alias("key")).agg(F.count(F.lit(1))).collect())


def _reach(counts: list[tuple], cut: int) -> tuple:
    """The key in whose rows the cut falls, and how many of its rows lie before the cut."""
    for key, rows in counts:
        if cut < rows:
            return key, cut
        cut -= rows
    return None, 0


def _nth_row(df: DataFrame, nth: int) -> tuple[dt.datetime, str]:
    """The row at place ``nth`` of a distributed ranking."""
    keys = df.select("timestamp", "meter_id")
    ranked = running_total(keys, [F.col("timestamp"), F.col("meter_id")], "_nth")
    found = ranked.where(F.col("_nth") == nth).first()
    return found["timestamp"], found["meter_id"]


def chronological_split(df: DataFrame, test_size: float) -> tuple[DataFrame, DataFrame]:
    """Both parts; never shuffled, the later rows are the test rows."""
    training = find_boundary(df, test_size).in_training()
    return df.where(training), df.where(~training)
