"""Difference measures between two prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symmetric_bps(left: Column, right: Column) -> Column:
    """Difference over the mean magnitude in basis points; NULL when both are zero."""
    scale = (F.abs(left) + F.abs(right)).cast("double") / 2
    return F.try_divide(F.abs(left - right).cast("double"), scale) * 10_000


def relative_bps(reference: Column, other: Column) -> Column:
    """Difference over the reference value in basis points."""
    return (
        F.try_divide(F.abs(reference - other).cast("double"), reference.cast("double")) * 10_000
    )


def within_symmetric_bps(left: Column, right: Column, tolerance: str | Column) -> Column:
    """Exact tolerance test in decimals, without a division."""
    bound = F.lit(tolerance).cast("decimal(12,4)")
    return F.abs(left - right) * 20_000 <= bound * (F.abs(left) + F.abs(right))


def within_relative_bps(reference: Column, other: Column, tolerance: str) -> Column:
    bound = F.lit(tolerance).cast("decimal(12,4)")
    return F.abs(reference - other) * 10_000 <= bound * reference
