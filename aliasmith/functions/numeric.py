"""Floating-point arithmetic by the rules of IEEE 754, where SQL gives null or fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def ln(x: Column) -> Column:
    """Natural logarithm: -Infinity at 0, NaN below and for NaN, null for null. x is named twice only, so that nesting stays small."""
    x = x.cast("double")
    return F.coalesce(F.ln(x), F.sqrt(x) + F.lit(-INF))


def div(a: Column, b: Column) -> Column:
    """Quotient of doubles; null if b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def div_or(a: Column, b: Column, other: float) -> Column:
    """Quotient of doubles; `other` if b is 0."""
    return F.coalesce(div(a, b), F.lit(other))


def f32(x: Column) -> Column:
    return x.cast("float")


def max_plain(a: Column, b: Column) -> Column:
    """The greater of two numbers of which none is NaN."""
    return F.when(a > b, a).otherwise(b)
