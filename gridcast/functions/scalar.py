"""Null-safe scalar expressions. Missing values are NULL only; a comparison with a missing value is 0.0, never NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_SCALE = 100.0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it doesn't or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Both bounds optional; a null stays null (least and greatest alone would skip it)."""
    y = x = col(x)
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    return F.when(x.isNotNull(), y)


def asinh100(x: Column | str) -> Column:
    return F.asinh(col(x) / PRICE_SCALE)


def sinh100(x: Column | str) -> Column:
    return F.sinh(col(x)) * PRICE_SCALE


def ratio(a: Column | str, b: Column | str, guard: float = 1.0) -> Column:
    """a / (b + guard); null where that denominator is zero."""
    return F.try_divide(col(a), col(b) + guard)


def row_sum(*xs: Column | str) -> Column:
    """Sum of the values that are there."""
    return reduce(lambda a, b: a + b, (F.coalesce(col(x), F.lit(0.0)) for x in xs))


def row_min(*xs: Column | str) -> Column:
    return F.least(*map(col, xs))


def row_max(*xs: Column | str) -> Column:
    return F.greatest(*map(col, xs))


def no_nan(x: Column | str) -> Column:
    """NaN would compare as larger than every number; it becomes NULL on entry."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x), x)


def to_number(x: Column | str) -> Column:
    return no_nan(col(x).try_cast("double"))


def to_time(x: Column | str) -> Column:
    return col(x).try_cast("timestamp")


def sin_turn(x: Column, period: float) -> Column:
    return F.sin(2 * F.pi() * x / period)


def cos_turn(x: Column, period: float) -> Column:
    return F.cos(2 * F.pi() * x / period)
