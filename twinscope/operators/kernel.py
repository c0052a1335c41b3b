"""Maximum mean discrepancy.

The linear and the polynomial kernel need moments only, so they take all rows in
one aggregate. The RBF kernel compares rows with rows and works on samples of a
stated size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import DISCRIMINATION, MMD
from ..pair import TablePair, row_key

KERNELS = ("rbf", "polynomial", "linear")
#: Rows of a side that kernels of pairs of rows look at.
MAX_SAMPLES = 5000


def _estimate(xx: Column, yy: Column, xy: Column, n: Column, m: Column, dx: Column, dy: Column, unbiased: bool) -> Column:
    """From the sums over all pairs, the diagonals and the counts."""
    n, m = n.cast("double"), m.cast("double")
    if unbiased:
        value = F.try_divide(xx - dx, n * (n - 1)) + F.try_divide(yy - dy, m * (m - 1)) - 2 * F.try_divide(xy, n * m)
    else:
        value = F.try_divide(xx, n * n) + F.try_divide(yy, m * m) - 2 * F.try_divide(xy, n * m)
    return F.greatest(value, F.lit(0.0))


def mmd_linear(pair: TablePair, columns: Sequence[str] | None = None, unbiased: bool = True) -> DataFrame:
    """``(column, mmd_squared)`` with the kernel x*y."""
    return mmd_polynomial(pair, columns, degree=1, gamma=1.0, coef0=0.0, unbiased=unbiased)


def mmd_polynomial(pair: TablePair, columns: Sequence[str] | None = None, degree: int = 3, gamma: float | None = None, coef0: float = 1.0, unbiased: bool = True) -> DataFrame:
    """``(column, mmd_squared)`` with the kernel (gamma*x*y + coef0)^degree, by power sums; gamma None is 1, one feature."""
    g = 1.0 if gamma is None else gamma
    v = F.col("value")
    r, f = F.when(F.col("side") == 1, v), F.when(F.col("side") == 0, v)
    power = lambda x, k: F.coalesce(F.sum(F.pow(x, F.lit(float(k)))), F.lit(0.0))
    kernel = lambda x: F.coalesce(F.sum(F.pow(g * x * x + coef0, F.lit(float(degree)))), F.lit(0.0))
    sums = pair.long(columns).groupBy("column").agg(
        F.count(r).alias("n"), F.count(f).alias("m"), kernel(r).alias("dx"), kernel(f).alias("dy"),
        *[power(r, k).alias(f"r{k}") for k in range(degree + 1)], *[power(f, k).alias(f"f{k}") for k in range(degree + 1)],
    )
    weight = [math.comb(degree, k) * g**k * coef0 ** (degree - k) for k in range(degree + 1)]
    total = lambda a, b: sum((w * F.col(f"{a}{k}") * F.col(f"{b}{k}") for k, w in enumerate(weight)), F.lit(0.0))
    return sums.select("column", _estimate(total("r", "r"), total("f", "f"), total("r", "f"), F.col("n"), F.col("m"), F.col("dx"), F.col("dy"), unbiased).alias("mmd_squared"))


def mmd_multivariate_moments(pair: TablePair, columns: Sequence[str] | None = None, degree: int = 1, gamma: float | None = None, coef0: float | None = None, unbiased: bool = True) -> DataFrame:
    """One row ``(mmd_squared, n_real, n_fake)`` of the joint polynomial kernel: sums of all monomials up to the degree, in one aggregate."""
    own = list(columns or pair.numerical)
    c0 = (0.0 if degree == 1 else 1.0) if coef0 is None else coef0
    g = (1.0 if degree == 1 else 1.0 / len(own)) if gamma is None else gamma
    monomials = [m for k in range(degree + 1) for m in combinations_with_replacement(range(len(own)), k)]
    rows = pair.tagged(own).select("side", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(own)]).na.drop()
    product = lambda m: math.prod([F.col(f"x{i}") for i in m], start=F.lit(1.0))
    dot = sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(len(own))), F.lit(0.0))
    on = lambda side, x: F.coalesce(F.sum(F.when(F.col("side") == side, x)), F.lit(0.0))
    sums = rows.agg(
        F.sum("side").alias("n"), F.sum(1 - F.col("side")).alias("m"), *[on(s, F.pow(g * dot + c0, F.lit(float(degree)))).alias(f"d{s}") for s in (0, 1)],
        *[on(s, product(m)).alias(f"s{s}_{j}") for s in (0, 1) for j, m in enumerate(monomials)],
    )

    def times(m: tuple[int, ...]) -> float:
        k = len(m)
        ways = math.factorial(k)
        for i in set(m):
            ways //= math.factorial(m.count(i))
        return math.comb(degree, k) * g**k * c0 ** (degree - k) * ways

    total = lambda a, b: sum((times(m) * F.col(f"s{a}_{j}") * F.col(f"s{b}_{j}") for j, m in enumerate(monomials)), F.lit(0.0))
    return sums.select(_estimate(total(1, 1), total(0, 0), total(1, 0), F.col("n"), F.col("m"), F.col("d1"), F.col("d0"), unbiased).alias("mmd_squared"), F.col("n").alias("n_real"), F.col("m").alias("n_fake"))


def _samples(pair: TablePair, own: Sequence[str], max_samples: int) -> tuple[DataFrame, DataFrame]:
    def take(df: DataFrame) -> DataFrame:
        vector = F.array(*[F.col(c).cast("double") for c in own])
        rows = df.select(*own).na.drop().orderBy(row_key(own, pair.seed), *own).limit(max_samples)
        return rows.select(vector.alias("v"), F.monotonically_increasing_id().alias("i"))

    return take(pair.real), take(pair.fake)


def _rbf(x: np.ndarray, y: np.ndarray, gamma: float | str | None, unbiased: bool) -> float:
    """One matrix of squared distances at a time; with ``pooled`` they are made twice."""

    def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        for k in range(a.shape[1]):
            out += (a[:, k, None] - b[None, :, k]) ** 2
        return out

    def scale(*d2: np.ndarray) -> float:
        apart = np.concatenate([m[m > 0] for m in d2])
        return 1 / (2 * float(np.median(np.sqrt(apart))) ** 2) if len(apart) else 0.0

    if gamma == "pooled":
        gamma = scale(squares(x, x), squares(y, y), squares(x, y))
    sums = []
    for a, b in ((x, x), (y, y), (x, y)):
        d2 = squares(a, b)
        g = float(gamma) if gamma is not None else scale(d2)
        sums.append(float(np.exp(-g * d2).sum()))
    n, m = len(x), len(y)
    if unbiased:  # the diagonal is 1 everywhere
        parts = [(sums[0] - n) / (n * (n - 1)) if n > 1 else float("nan"), (sums[1] - m) / (m * (m - 1)) if m > 1 else float("nan"), sums[2] / (n * m) if n * m else float("nan")]
    else:
        parts = [sums[0] / (n * n), sums[1] / (m * m), sums[2] / (n * m)] if n * m else [float("nan")] * 3
    return max(parts[0] + parts[1] - 2 * parts[2], 0.0)


def _rbf_each(pair: TablePair, groups: dict[str, Sequence[str]], gamma: float | str | None, max_samples: int, unbiased: bool) -> DataFrame:
    """``(column, mmd_squared, n_real, n_fake)`` of several sets of columns, a task each: ``max_samples`` rows a side at most are in it."""
    out: DataFrame | None = None
    for name, own in groups.items():
        for side, df in zip((1, 0), _samples(pair, own, max_samples), strict=True):
            rows = df.select(F.lit(name).alias("column"), F.lit(side).alias("side"), "v")
            out = rows if out is None else out.unionByName(rows)

    def solve(pdf):
        import pandas as pd

        x, y = (np.array(pdf[pdf.side == s]["v"].tolist(), dtype=float) for s in (1, 0))
        value = _rbf(x, y, gamma, unbiased) if len(x) and len(y) else float("nan")
        return pd.DataFrame({"column": [pdf.column.iloc[0]], "mmd_squared": [value], "n_real": [len(x)], "n_fake": [len(y)]})

    found = out.groupBy("column").applyInPandas(solve, "column string, mmd_squared double, n_real long, n_fake long")
    return found.withColumn("mmd_squared", F.nanvl("mmd_squared", F.lit(None).cast("double")))


def mmd_rbf(pair: TablePair, columns: Sequence[str] | None = None, gamma: float | str | None = None, max_samples: int = MAX_SAMPLES, unbiased: bool = True) -> DataFrame:
    """One row ``(mmd_squared, n_real, n_fake)``: joint RBF kernel over ``max_samples`` rows a side by hash order.

    ``gamma`` None takes 1/(2*median^2) of the nonzero distances of each of the
    three matrices; ``pooled`` takes one median over all three.
    """
    return _rbf_each(pair, {"": list(columns or pair.numerical)}, gamma, max_samples, unbiased).drop("column")


def mmd_custom(pair: TablePair, kernel: Callable[[Column, Column], Column], columns: Sequence[str] | None = None, max_samples: int = 2000, unbiased: bool = True) -> DataFrame:
    """One row ``(mmd_squared,)`` for a kernel given as a function of two array columns, over samples."""
    own = list(columns or pair.numerical)
    real, fake = _samples(pair, own, max_samples)

    def sums(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        j = a.select(F.col("v").alias("va"), F.col("i").alias("ia")).crossJoin(F.broadcast(b.select(F.col("v").alias("vb"), F.col("i").alias("ib"))))
        k = kernel(F.col("va"), F.col("vb"))
        return j.agg(F.sum(k).alias(name), F.sum(F.when(F.col("ia") == F.col("ib"), k)).alias(f"d{name}"), F.count("*").alias(f"n{name}"))

    row = sums(real, real, "xx").join(F.broadcast(sums(fake, fake, "yy"))).join(F.broadcast(sums(real, fake, "xy")))
    return row.select(_estimate(F.col("xx"), F.col("yy"), F.col("xy"), F.sqrt("nxx"), F.sqrt("nyy"), F.col("dxx"), F.col("dyy"), unbiased).alias("mmd_squared"))


def mmd_column_wise(pair: TablePair, columns: Sequence[str] | None = None, kernel: str = "rbf", max_samples: int = MAX_SAMPLES, **how) -> DataFrame:
    """``(column, mmd_squared, kernel)``."""
    own = list(columns or pair.numerical)
    if kernel == "linear":
        out = mmd_linear(pair, own, **how)
    elif kernel == "polynomial":
        out = mmd_polynomial(pair, own, **how)
    elif kernel == "rbf":
        out = _rbf_each(pair, {c: [c] for c in own}, how.get("gamma"), max_samples, how.get("unbiased", True))
    else:
        raise ValueError(f"kernel must be one of {KERNELS}")
    return out.select("column", "mmd_squared", F.lit(kernel).alias("kernel"))


def mmd_multivariate(pair: TablePair, columns: Sequence[str] | None = None, kernel: str = "rbf", max_samples: int = MAX_SAMPLES, **how) -> DataFrame:
    """One row ``(kernel, mmd_squared, n_real, n_fake)``."""
    if kernel == "rbf":
        out = mmd_rbf(pair, columns, max_samples=max_samples, **how)
    elif kernel in ("linear", "polynomial"):
        out = mmd_multivariate_moments(pair, columns, degree=1 if kernel == "linear" else 3, **how)
    else:
        raise ValueError(f"kernel must be one of {KERNELS}")
    return out.select(F.lit(kernel).alias("kernel"), "mmd_squared", "n_real", "n_fake")


def mmd_evaluation(pair: TablePair, columns: Sequence[str] | None = None, kernels: Sequence[str] = KERNELS, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """A row a kernel: mean, median and largest column-wise value, the joint value, quality 1/(1+mean), rating, and whether it tells the sides apart best."""
    out: DataFrame | None = None
    for k in kernels:
        each = mmd_column_wise(pair, columns, k, max_samples).agg(
            F.lit(k).alias("kernel"), F.avg("mmd_squared").alias("mean_mmd"), F.percentile("mmd_squared", F.lit(0.5)).alias("median_mmd"), F.max("mmd_squared").alias("max_mmd")
        )
        joint = mmd_multivariate(pair, columns, k, max_samples).select(F.col("mmd_squared").alias("joint_mmd"))
        row = each.join(F.broadcast(joint))
        out = row if out is None else out.unionByName(row)
    from pyspark.sql import Window

    best = F.row_number().over(Window.orderBy(F.desc("joint_mmd"), "kernel")) == 1  # a row a kernel
    return out.select("kernel", "mean_mmd", "median_mmd", "max_mmd", "joint_mmd", (1 / (1 + F.col("mean_mmd"))).alias("quality"), MMD.column(F.col("mean_mmd")).alias("rating"), DISCRIMINATION.column(F.col("joint_mmd")).alias("discrimination"), best.alias("best_kernel"))
