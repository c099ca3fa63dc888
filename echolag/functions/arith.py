"""Absolute support thresholds from relative ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def support_floor(min_sup: float | Column, n_points: Column) -> Column:
    """Smallest number of occurrences that reaches ``min_sup``."""
    return F.ceil(_double(min_sup) * n_points).cast("long")


def support_ceiling(max_sup: float | Column, n_points: Column) -> Column:
    """Largest number of occurrences that stays within ``max_sup``."""
    return F.floor(_double(max_sup) * n_points).cast("long")
