"""Rounding, integer conversion and guarded division with Python's semantics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_2dp(value: Column) -> Column:
    """Two decimals, half-even on the exact binary value (2.675 -> 2.67, 0.125 -> 0.12).

    `round` and `bround` look at the shortest decimal text of the double instead.
    Meant for aggregated results, since it goes through a string. Infinity gives NULL.
    """
    return F.regexp_replace(F.format_number(value, 2), ",", "").try_cast("double")


def seconds_2dp(micros: Column) -> Column:
    """Whole, not negative microseconds as seconds with two decimals, rounded as `round_2dp` does.

    Only an exact half of a hundredth depends on the binary value and needs its text.
    """
    hundredths = F.floor((micros + 5000) / 10_000)
    return F.when(micros % 10_000 == 5000, round_2dp(micros / F.lit(1e6))).otherwise(hundredths / F.lit(100.0))


def truncate(value: Column) -> Column:
    """Whole number toward zero."""
    return value.cast("bigint")


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 where the denominator is zero or null."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def std_or_zero(value: Column) -> Column:
    """Population standard deviation, 0.0 for an empty group."""
    return F.coalesce(F.stddev_pop(value), F.lit(0.0))
