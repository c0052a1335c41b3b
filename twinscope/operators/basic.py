"""Agreement of summary statistics, principal components, and the registry of comparison measures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..pair import TablePair
from .dist import steps_of

STATISTICS = ("mean", "median", "std", "var")


def statistics_vector(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, statistic, real, fake)``: mean, median, sample deviation and variance."""
    r, f = F.when(F.col("side") == 1, F.col("value")), F.when(F.col("side") == 0, F.col("value"))
    makers = {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp}
    wide = pair.long(columns).groupBy("column").agg(*[make(x).alias(f"{s}_{side}") for s, make in makers.items() for side, x in (("real", r), ("fake", f))])
    # the two middle values, from the distribution functions: no task holds a column
    half = lambda c, n: F.min(F.when(F.col(c) >= F.floor((F.col(n) + 1) / 2), F.col("value"))) + F.min(F.when(F.col(c) >= F.floor(F.col(n) / 2) + 1, F.col("value")))
    middle = steps_of(pair, columns).groupBy("column").agg((half("cr", "nr") / 2).alias("median_real"), (half("cf", "nf") / 2).alias("median_fake"))
    wide = wide.join(F.broadcast(middle), "column")  # a row a column
    parts = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(f"{s}_real").alias("real"), F.col(f"{s}_fake").alias("fake")) for s in STATISTICS])
    return wide.select("column", F.explode(parts).alias("e")).select("column", "e.*")


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def pearsonr(x: Sequence[float], y: Sequence[float]) -> float:
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 2:
        return 0.0
    a, b = x - x.mean(), y - y.mean()
    low = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / low) if low else 0.0


def spearmanr(x: Sequence[float], y: Sequence[float]) -> float:
    return pearsonr(average_ranks(np.asarray(x, float)), average_ranks(np.asarray(y, float)))


def kendalltau(x: Sequence[float], y: Sequence[float]) -> float:
    x, y = np.asarray(x, float), np.asarray(y, float)
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    low = np.sqrt((sx**2).sum() * (sy**2).sum())
    return float((sx * sy).sum() / low) if low else 0.0


def linregress(x: Sequence[float], y: Sequence[float]) -> float:
    """The slope of y on x; 0 for a constant x."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    a = x - x.mean()
    low = (a * a).sum()
    return float((a * (y - y.mean())).sum() / low) if low else 0.0


def somersd(x: Sequence[float], y: Sequence[float]) -> float:
    """Somers' D of y given x: agreeing less disagreeing pairs over those that x doesn't tie."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    low = (sx**2).sum()
    return float((sx * sy).sum() / low) if low else 0.0


def weightedtau(x: Sequence[float], y: Sequence[float]) -> float:
    """Kendall's tau with hyperbolic weights of both places, the mean of both vectors' orders from the largest down."""
    x, y = np.asarray(x, float), np.asarray(y, float)

    def one(first: np.ndarray, second: np.ndarray) -> float:
        rank = np.empty(len(x))
        rank[np.lexsort((second, first))[::-1]] = np.arange(len(x))
        w = 1 / (rank[:, None] + 1) + 1 / (rank[None, :] + 1)
        sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
        np.fill_diagonal(w, 0)
        low = np.sqrt((w * sx**2).sum() * (w * sy**2).sum())
        return float((w * sx * sy).sum() / low) if low else 0.0

    return (one(x, y) + one(y, x)) / 2


def pointbiserialr(x: Sequence[float], y: Sequence[float]) -> float:
    """Pearson of a vector of two values with any other."""
    return pearsonr(x, y)


METRICS: dict[str, Callable] = {f.__name__: f for f in (pearsonr, spearmanr, kendalltau, weightedtau, somersd, linregress, pointbiserialr)}


def metric(how: str | Callable) -> Callable[[Sequence[float], Sequence[float]], float]:
    """A comparison by name, or any callable of two vectors; one that returns ``(statistic, p)`` gives its statistic."""
    if callable(how):
        def call(x, y):
            out = how(x, y)
            return float(out[0]) if isinstance(out, tuple) else float(out)

        return call
    if how not in METRICS:
        raise ValueError(f"unknown metric {how}; known are {sorted(METRICS)}")
    return METRICS[how]


def basic_statistical_evaluation(pair: TablePair, columns: Sequence[str] | None = None) -> float:
    """Spearman's rho over the statistics of all columns: four rows a column reach the driver."""
    rows = statistics_vector(pair, columns).where("real is not null and fake is not null").collect()
    return spearmanr([r["real"] for r in rows], [r["fake"] for r in rows])


def _covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and number of rows complete in ``columns``: one aggregate of k*k values."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    k = len(columns)
    cells = [F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    got = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *cells).first()
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = got[f"c{i}_{j}"] or 0.0
    return np.array([got[f"m{i}"] or 0.0 for i in range(k)]), cov, got["n"]


def explained_variances(df: DataFrame, columns: Sequence[str], most: int = 5) -> np.ndarray:
    """The largest eigenvalues of the sample covariance, ``min(most, columns, rows - 1)`` of them."""
    _, cov, n = _covariance(df, columns)
    return np.linalg.eigvalsh(cov)[::-1][: max(0, min(most, len(columns), n - 1))]


def pca_correlation(pair: TablePair, columns: Sequence[str] | None = None, lingress: bool = False, how: str | Callable = "pearsonr") -> float:
    """1 - MAPE of the explained variances of both sides, or their ``how`` comparison if ``lingress``."""
    own = list(columns or pair.numerical)
    real, fake = explained_variances(pair.real, own), explained_variances(pair.fake, own)
    n = min(len(real), len(fake))
    real, fake = real[:n], fake[:n]
    if lingress:
        return metric(how)(real, fake)
    keep = real != 0
    return float(1 - np.abs((real[keep] - fake[keep]) / real[keep]).mean()) if keep.any() else 0.0


def pca_projection(pair: TablePair, columns: Sequence[str] | None = None, k: int = 2) -> DataFrame:
    """``(side, pc1, pc2, ...)``: both sides on the components of the real side, centred on its mean."""
    own = list(columns or pair.numerical)
    mean, cov, _ = _covariance(pair.real, own)
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, np.argsort(values)[::-1][:k]]
    top = top * np.where(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])] < 0, -1.0, 1.0)  # the sign that makes the largest part positive
    rows = pair.tagged(own).na.drop()
    out = []
    for j in range(top.shape[1]):
        value = F.lit(0.0)
        for i, c in enumerate(own):
            value = value + (F.col(c).cast("double") - float(mean[i])) * float(top[i, j])
        out.append(value.alias(f"pc{j + 1}"))
    return rows.select("side", *out)
