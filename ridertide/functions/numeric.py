"""Null-safe numeric expressions.

Missing values are NULL everywhere, never NaN: a comparison with NULL is NULL, and aggregates skip it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-9


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is NULL when the divisor is zero."""
    return top / F.nullif(bottom, F.lit(0.0))


def to_long(value: Column) -> Column:
    """Lenient whole-number cast: unreadable text and fractions with a zero part ('12.0') are accepted."""
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))


def flag(condition: Column) -> Column:
    """0/1 flag; a comparison with a missing side gives 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def power(base: Column, gamma: float) -> Column:
    return base if gamma == 1.0 else F.pow(base, F.lit(float(gamma)))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def load_weight(y: Column, mean: Column, gamma: float) -> Column:
    """Weight of an anchor by its load against the station mean."""
    return power(F.greatest(y, F.lit(0.0)) / F.greatest(mean, F.lit(FLOOR)), gamma)


def row_mean(columns: list[Column]) -> Column:
    return total(columns) / F.lit(float(len(columns)))


def row_std(columns: list[Column]) -> Column:
    """Population deviation across columns of one row."""
    mean = row_mean(columns)
    return F.sqrt(total([(c - mean) * (c - mean) for c in columns]) / F.lit(float(len(columns))))


def row_min(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def row_max(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]
