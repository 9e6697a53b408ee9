"""Hashes that depend on the row alone, never on partition layout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def hash32(*parts: Column, sep: str = "|") -> Column:
    """The first 32 bits of md5 over the joined parts, as a bigint in [0, 2^32)."""
    text = F.concat_ws(sep, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def unit_interval(*parts: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return hash32(*parts) / F.lit(float(HASH_RANGE))
