"""Scalar expressions over measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and ±inf become NULL; every source applies this on entry. One comparison
    does: Spark orders NaN above infinity."""
    return F.when(F.abs(c) < float("inf"), c)


def clip(c: Column, low: float = -5.0, high: float = 5.0) -> Column:
    """Bound a value; a plain greatest() would turn NULL into the bound."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def nonzero_scale(c: Column) -> Column:
    """A zero or missing scale counts as 1."""
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))


def softplus(x: Column) -> Column:
    """ln(1+e^x) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def log_factorial(n: Column) -> Column:
    """ln n! from Stirling's series, shifted by 8 for small n (error < 1e-12).

    Closed form, so no running total over 1..n has to be built.
    """
    x = n.cast("double") + 1.0
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    y = x + 8.0
    inverse = 1.0 / (y * y)
    series = (1.0 / 12.0 - inverse * (1.0 / 360.0 - inverse * (1.0 / 1260.0 - inverse / 1680.0))) / y
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)
