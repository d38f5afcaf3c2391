"""Aggregate expressions whose result does not depend on how rows were partitioned.

Summing doubles in another order changes the last bits, and a quotient can miss the decimal it
stands for by one bit. Rounding sums to eight and quotients to ten digits removes that noise
before it can tip a half at the fourth digit, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUM_DIGITS = 8
QUOTIENT_DIGITS = 10


def settled(value: str | Column, digits: int) -> Column:
    """Round a quotient to ``digits`` without being misled by its last bit."""
    return F.round(F.round(value, QUOTIENT_DIGITS), digits)


def total(column: str | Column, digits: int = 4) -> Column:
    return F.round(F.round(F.sum(column), SUM_DIGITS), digits)


def mean(column: str | Column) -> Column:
    return F.round(F.try_divide(F.round(F.sum(column), SUM_DIGITS), F.count(column)), QUOTIENT_DIGITS)


def rounded_mean(column: str | Column, digits: int = 4) -> Column:
    return F.round(mean(column), digits)


def rows() -> Column:
    return F.count(F.lit(1))


def share(part: Column, whole: Column) -> Column:
    """Percentage with 0 for an empty or missing whole."""
    return F.lit(100.0) * F.coalesce(F.try_divide(part, whole), F.lit(0.0))
