"""Rounding, growth, concentration, rank: Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go up, also below zero (SCL14); Spark's round goes away from 0."""
    k = 10**digits
    return F.floor(c * F.lit(float(k)) + 0.5) / F.lit(float(k))


def clamp01(c: Column) -> Column:
    """c within 0 and 1; null stays null, though greatest and least pass over nulls."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def growth_pct(before: Column, after: Column) -> Column:
    """(after - before) / before in per cent, one decimal; null from nothing (SCL15)."""
    return F.when(before != 0, half_up((after - before) / before * 100, 1))


def growth_of(first: Column, last: Column) -> Column:
    return F.when(first > 0, (last - first) / first).when(last > 0, 1.0).otherwise(0.0)


def smoothed(first: Column, last: Column) -> Column:
    return (last + 1) / (first + 1)


def band(hhi: Column) -> Column:
    return F.when(hhi > 1800, "high").when(hhi >= 1000, "moderate").otherwise("low")
