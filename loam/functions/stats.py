"""Statistical column expressions with pandas semantics and ANSI-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """Spark keeps NaN apart from NULL; pandas treats both as missing."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def clean_double(c: Column) -> Column:
    return nan_to_null(c.cast("double"))


def corrected_skew(n: Column, g1: Column) -> Column:
    """Bias-corrected sample skewness G1 from population skewness g1 (NULL for n < 3)."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from population excess kurtosis g2 (NULL for n < 4)."""
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def pairwise(x: Column, y: Column) -> tuple[Column, Column]:
    """Keep only rows where both values are present (pairwise-complete)."""
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation on pairwise-complete rows; NULL (not an error) when undefined."""
    xp, yp = pairwise(x, y)
    denom = F.stddev_samp(xp) * F.stddev_samp(yp)
    return nan_to_null(F.try_divide(F.covar_samp(xp, yp), F.when(denom != 0, denom)))


def safe_z(x: Column, mean: Column, std: Column) -> Column:
    """|x - mean| / std, NULL when std is 0 or missing."""
    return F.abs(F.try_divide(x - mean, F.when(std != 0, std)))
