"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
Z95 = 1.959963984540054

# Abramowitz & Stegun 7.1.26, absolute error below 1.5e-7.
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function for ``x >= 0``."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERFC_A):
        poly = t * (F.lit(a) + poly)
    return poly * F.exp(-x * x)


def two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / F.sqrt(F.lit(2.0))))


def clip(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def logit(p: Column, eps: float = EPS) -> Column:
    q = clip(p, eps)
    return F.log(q / (F.lit(1.0) - q))


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def rounded(x: Column, digits: int = 6) -> Column:
    """Nearest whole number of ``x * 10^digits`` in doubles, halves away from zero; Spark's ``round`` takes the shortest decimal of ``x`` instead."""
    y = x * F.lit(10.0**digits)
    whole = F.rint(y)
    off = y - whole
    return F.when((off == 0.5) & (y > 0), whole + 1).when((off == -0.5) & (y < 0), whole - 1).otherwise(whole) / F.lit(10.0**digits)


def mean_ci(values: Column) -> dict[str, Column]:
    """Mean, sample sd and normal 95 % interval of the finite values; one value has sd 0."""
    v = F.when(values.isNotNull() & ~F.isnan(values) & (F.abs(values) != F.lit(float("inf"))), values)
    n = F.count(v)
    mean = F.avg(v)
    sd = F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))
    half = F.lit(Z95) * sd / F.sqrt(n)
    return {"mean": mean, "sd": sd, "ci_low": mean - half, "ci_high": mean + half}
