"""Numeric arrays and elementwise payload arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import Cols, col


def normalized(array: Cols) -> Column:
    """Each element scaled to 0..1 by the array's range; a flat array is divided by 1; one that holds NaN becomes NaN throughout."""
    a = F.transform(col(array), lambda x: x.cast("double"))
    low, high = F.array_min(a), F.array_max(a)
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    bad = F.exists(a, lambda x: F.isnan(x))
    return F.when(bad, F.transform(a, lambda x: F.lit(float("nan")))).otherwise(F.transform(a, lambda x: (x - low) / span))


def scaled(array: Cols, factor: float | Column) -> Column:
    return F.transform(col(array), lambda x: x.cast("double") * factor)


def mean(array: Cols) -> Column:
    """Mean of the elements, null for an empty array."""
    total = F.aggregate(col(array), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.try_divide(total, F.size(col(array)))


def ratio_or_zero(top: Cols, bottom: Cols) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.when(col(bottom) == 0, F.lit(0.0)).otherwise(F.try_divide(col(top), col(bottom)))


def finite(value: Cols) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    d = col(value).cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
