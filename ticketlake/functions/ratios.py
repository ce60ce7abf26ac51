"""Ratios with a zero guard, rounded from exact integers.

Half-up on the exact fraction, so every engine and every partitioning gives the same digits.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _scaled(part: Column, whole: Column, scale: int) -> Column:
    part, whole = part.cast("bigint"), F.nullif(whole.cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", F.lit(2 * scale).cast("bigint") * part + whole, whole * 2)


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; 0.0 when there is nothing to divide by."""
    return F.coalesce(_scaled(part, whole, 10_000) / F.lit(100.0), F.lit(0.0))


def rate(part: Column, whole: Column) -> Column:
    """Share with four decimals; 0.0 when there is nothing to divide by."""
    return F.coalesce(_scaled(part, whole, 10_000) / F.lit(10_000.0), F.lit(0.0))
