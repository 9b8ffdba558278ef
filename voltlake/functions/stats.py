"""Statistics that Spark has no function for, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order in which summary statistics are named and laid out.
SUMMARY = ("var", "min", "mean", "skew", "kurtosis", "sum", "sum_square")


def kurtosis_unbiased(x: Column) -> Column:
    """Pearson kurtosis corrected for bias: G2 + 3; null below four values or without spread."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3)


def log_abs(x: Column) -> Column:
    """log10 |x|; null at 0."""
    return F.log10(F.nullif(F.abs(x), F.lit(0.0)))


def summary_columns(x: Column, prefix: str, log: bool = True, digits: int | None = None) -> list[Column]:
    """Aggregates var, min, mean, skew, kurtosis, sum of |x| and sum of squares, as log10 of their size if log."""
    found = [F.var_pop(x), F.min(x), F.avg(x), F.skewness(x), kurtosis_unbiased(x), F.sum(F.abs(x)), F.sum(x * x)]
    out = [log_abs(f) if log else f for f in found]
    if digits is not None:
        out = [F.round(F.nanvl(o, F.lit(None).cast("double")), digits) for o in out]
    return [o.alias(f"{prefix}_{name}") for o, name in zip(out, SUMMARY)]


def gradient(y: str, x: str, window) -> Column:
    """Second-order differences of unevenly spaced samples; one-sided at both ends."""
    h0, h1 = F.col(x) - F.lag(x).over(window), F.lead(x).over(window) - F.col(x)
    d0, d1 = (F.col(y) - F.lag(y).over(window)) / h0, (F.lead(y).over(window) - F.col(y)) / h1
    return F.coalesce((d0 * h1 + d1 * h0) / (h0 + h1), d0, d1)
