"""Vector distances as aggregate columns, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def mean_absolute_error(a: Column | str, b: Column | str) -> Column:
    return F.avg(F.abs(_d(a) - _d(b)))


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.sum(F.pow(_d(a) - _d(b), F.lit(2.0))))


def mean_absolute_percentage_error(true: Column | str, pred: Column | str) -> Column:
    """Infinite where a true value of zero is missed; a true zero that is met adds nothing to the sum."""
    off = F.abs(_d(true) - _d(pred))
    part = F.when((_d(true) == 0) & (off > 0), F.lit(float("inf"))).otherwise(F.coalesce(F.try_divide(off, F.abs(_d(true))), F.when(off == 0, F.lit(0.0))))
    return F.avg(part)


def rmse(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.avg(F.pow(_d(a) - _d(b), F.lit(2.0))))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(F.sum(_d(a) * _d(b)), F.sqrt(F.sum(_d(a) * _d(a))) * F.sqrt(F.sum(_d(b) * _d(b))))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson; null if either side is constant."""
    return F.try_divide(F.covar_pop(_d(a), _d(b)), F.stddev_pop(_d(a)) * F.stddev_pop(_d(b)))


def weighted_correlation(a: Column | str, b: Column | str, w: Column | str) -> Column:
    """Pearson of pairs that occur ``w`` times each; null if either side is constant. Both should have means near 0: see ``weighted_correlations``."""
    x, y, n = _d(a), _d(b), _d(w)
    total = F.sum(n)
    xy = F.sum(n * x * y) - F.sum(n * x) * F.sum(n * y) / total
    xx = F.sum(n * x * x) - F.sum(n * x) * F.sum(n * x) / total
    yy = F.sum(n * y * y) - F.sum(n * y) * F.sum(n * y) / total
    return F.try_divide(xy, F.sqrt(F.greatest(xx, F.lit(0.0))) * F.sqrt(F.greatest(yy, F.lit(0.0))))


def weighted_correlations(df: DataFrame, key: str, a: str, b: str, w: str) -> DataFrame:
    """``(key, correlation)``: Pearson for each key of pairs that occur ``w`` times; the means are taken off first, so that no digits are lost."""
    mean = lambda c: F.sum(_d(w) * _d(c)) / F.sum(_d(w))
    means = df.groupBy(key).agg(mean(a).alias("__ma"), mean(b).alias("__mb"))  # a row a key
    off = df.join(F.broadcast(means), key).select(key, (_d(a) - F.col("__ma")).alias("__a"), (_d(b) - F.col("__mb")).alias("__b"), _d(w).alias("__w"))
    return off.groupBy(key).agg(weighted_correlation("__a", "__b", "__w").alias("correlation"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def array_cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
