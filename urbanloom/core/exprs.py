"""Column expressions shared by the operator families. Non-finite numbers count as missing (null)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7 (neither engine has erf).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    return F.least(c, F.lit(float(hi))) if hi is not None else c


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def two_sided_p(z: Column) -> Column:
    return 1 - erf(F.abs(z) / F.sqrt(F.lit(2.0)))


def over_all(partition: list[str] | None = None):
    return Window.partitionBy(*(partition or []))


def minmax(c: Column, w, default: float = 0.0) -> Column:
    """(x - min) / (max - min) over the window; ``default`` where the range is 0."""
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi > lo, (c - lo) / (hi - lo)).when(c.isNotNull(), F.lit(default))


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)
