"""Arithmetic on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ln


def inner(a: Column, b: Column) -> Column:
    """Dot product in double; null if a vector is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(inner(a, b), d))


def quantize(a: Column, q: Column | int) -> Column:
    """sign(x) trunc(|x| q) of each component."""
    q = F.lit(q) if isinstance(q, int) else q
    return F.transform(a, lambda x: F.when(x < 0, -F.floor(-x.cast("double") * q)).otherwise(F.floor(x.cast("double") * q)).cast("int"))


def dequantize(a: Column, q: Column | int) -> Column:
    """Midpoint of each component's cell; 0 stays."""
    q = F.lit(q) if isinstance(q, int) else q
    return F.transform(a, lambda n: F.try_divide(n.cast("double") + F.lit(0.5) * F.signum(n.cast("double")), q.cast("double")))


def natural(n: Column) -> Column:
    """Signed number as a natural one: 2n from 0 on, -2n - 1 below."""
    return F.when(n >= 0, n * 2).otherwise(-n * 2 - 1)


def golomb_modulus(n: Column, total: Column) -> Column:
    """ceil(ln(2 - f) / -ln(1 - f)), f = n / total; 0 if total <= n."""
    f = F.try_divide(n.cast("double"), total.cast("double"))
    return F.when(total > n, F.ceil(F.try_divide(F.ln(F.lit(2.0) - f), -F.ln(F.lit(1.0) - f)))).otherwise(F.lit(0)).cast("int")


def golomb_bits(a: Column) -> Column:
    """Estimate of the bits that the vector takes in a Golomb code; 0 for zeros."""
    nat = F.transform(a, lambda x: F.when(x >= 0, x.cast("double") * 2).otherwise(-(x.cast("double") * 2 + 1)))
    total = F.aggregate(nat, F.lit(0.0), lambda s, x: s + x)
    f = F.try_divide(F.size(a).cast("double"), total)
    m = F.ceil(F.try_divide(ln(F.lit(2.0) - f), -ln(F.lit(1.0) - f))).cast("double")
    b = F.ceil(ln(m)).cast("double")
    bits = F.aggregate(nat, F.lit(0.0), lambda s, x: s + F.try_divide(x, m) + 1 + F.when(x < F.pow(F.lit(2.0), b) - m, b - 1).otherwise(b))
    return F.when(total == 0, F.lit(0.0)).otherwise(bits)
