"""Durations between timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with the fraction kept."""
    return micros_between(start, end) / F.lit(1e6)


def whole_seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds, truncated toward zero for each pair."""
    return seconds_between(start, end).cast("bigint")


def finished_or_null(ts: Column) -> Column:
    """Null for a timestamp at or before the epoch, which stands for "not finished"."""
    return F.when(micros(ts) > 0, ts)


def duration_or_null(start: Column, end: Column) -> Column:
    """Seconds between, null when negative. Not yet rounded."""
    elapsed = seconds_between(start, end)
    return F.when(elapsed >= 0, elapsed)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, as a sortable whole number."""
    return F.unix_micros(ts.cast("timestamp"))
