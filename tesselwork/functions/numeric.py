"""Rounding, angles and other numeric rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def floor_mod(x: Column, by: float) -> Column:
    """Never negative for a positive divisor."""
    return F.pmod(x, F.lit(by))


def half_up_pixel(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def ratio(a: Column, b: Column) -> Column:
    """Null, not zero, where the denominator is zero."""
    return F.when(b != 0, a / b)


def mode_first(value: str, n: str, position: str) -> Column:
    """An aggregate over counted values: the most frequent, of equals the one seen first."""
    return F.max_by(F.col(value), F.struct(F.col(n), -F.col(position)))
