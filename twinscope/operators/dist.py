"""Distances between the distributions of numerical columns.

All columns of a pair go through one long table. Empirical distribution functions
are built in two levels: values are counted, cut into ranges that grow in number
with the table, accumulated inside each range, written once, and shifted by the
totals of the ranges before it. No task holds a whole column, and all measures of
a pair read the one written table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratings import WASSERSTEIN
from ..pair import TablePair
from .ordered import Segments, ordered


def ecdf(long: DataFrame) -> DataFrame:
    """``(column, value, a, b, cr, cf, nr, nf, nxt)``, a row a distinct value of ``long (column, side, value)``.

    ``a`` and ``b`` count the value on either side, ``cr`` and ``cf`` all values up
    to it, ``nr`` and ``nf`` all; ``nxt`` is the next value of the column.
    """
    side = F.col("side")
    counted = long.groupBy("column", "value").agg(F.sum(side).cast("long").alias("a"), F.sum(1 - side).cast("long").alias("b"))

    def add(own: Segments) -> dict[str, np.ndarray]:
        return {"ra": own.running(own["a"]), "rb": own.running(own["b"]), "next": own.following(own["value"])}

    steps = ordered(counted, ["column"], ["value"], add, "ra long, rb long, next double", "ecdf")
    totals = steps.groupBy("column", "part").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.min("value").alias("low"))
    over = Window.partitionBy("column").orderBy("part")  # a row a range
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    totals = totals.select(
        "column", "part",
        F.coalesce(F.sum("ta").over(before), F.lit(0)).alias("pa"), F.coalesce(F.sum("tb").over(before), F.lit(0)).alias("pb"),
        F.sum("ta").over(whole).alias("nr"), F.sum("tb").over(whole).alias("nf"), F.lead("low").over(over).alias("next_low"),
    )
    return steps.join(F.broadcast(totals), ["column", "part"]).select(
        "column", "value", "a", "b", (F.col("pa") + F.col("ra")).alias("cr"), (F.col("pb") + F.col("rb")).alias("cf"), "nr", "nf", F.coalesce("next", "next_low").alias("nxt"),
    )


def steps_of(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """The pair's ``ecdf``, written once for each choice of columns and shared by all measures."""
    own = tuple(columns or pair.numerical)
    return pair.once(("ecdf", own), lambda: ecdf(pair.long(own)))


def _finite(steps: DataFrame) -> DataFrame:
    return steps.withColumn("value", F.when(F.abs("value") == float("inf"), F.raise_error(F.lit("infinite value"))).otherwise(F.col("value")))


def quantile_pieces(steps: DataFrame, by_rank: bool = False) -> DataFrame:
    """``(column, width, x, y)``: where both quantile functions are constant, how wide, and their values there.

    The functions change at the shares ``cr / nr`` and ``cf / nf``, or, ``by_rank``, at
    the ranks ``cr`` and ``cf`` themselves, up to the shorter side's last.
    """
    own = lambda c, n: F.col(c).cast("double") if by_rank else F.col(c).cast("double") / F.col(n)
    none = F.lit(None).cast("double")
    real = steps.where("a > 0").select("column", "nr", "nf", own("cr", "nr").alias("u"), F.col("value").alias("x"), none.alias("y"))
    fake = steps.where("b > 0").select("column", "nr", "nf", own("cf", "nf").alias("u"), none.alias("x"), F.col("value").alias("y"))
    both = real.unionByName(fake)
    marks = both.select("column", "u", "x", "y", (F.least("nr", "nf").cast("double") if by_rank else F.lit(1.0)).alias("most"))
    return merged(marks)


def merged(marks: DataFrame) -> DataFrame:
    """``(column, width, x, y)`` of two step functions from ``marks (column, u, x, y, most)``: a row each step of either, its value, and the place ``u`` it holds up to."""
    marks = marks.groupBy("column", "u").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("most").alias("most"))

    def add(own: Segments) -> dict[str, np.ndarray]:
        return {"u0": own.preceding(own["u"]), "x1": own.next_known(own["x"]), "y1": own.next_known(own["y"])}

    marks = ordered(marks, ["column"], ["u"], add, "u0 double, x1 double, y1 double", "quantiles")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("u")))
    ends = marks.groupBy("column", "part").agg(F.max("u").alias("top"), first("x").alias("fx"), first("y").alias("fy"))
    over = Window.partitionBy("column").orderBy("part")  # a row a range
    later = over.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select("column", "part", F.coalesce(F.lag("top").over(over), F.lit(0.0)).alias("from"), F.first("fx", ignorenulls=True).over(later).alias("lx"), F.first("fy", ignorenulls=True).over(later).alias("ly"))
    start = F.coalesce("u0", "from")
    width = F.least("u", "most") - start
    pieces = marks.join(F.broadcast(ends), ["column", "part"]).select("column", width.alias("width"), F.coalesce("x1", "lx").alias("x"), F.coalesce("y1", "ly").alias("y"))
    return pieces.where("width > 0 and x is not null and y is not null")


def _gap() -> Column:
    share = lambda c, n: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(n).cast("double")), F.lit(0.0))
    return F.abs(share("cr", "nr") - share("cf", "nf"))


def ks(pair: TablePair, columns: Sequence[str] | None = None, p_value_threshold: float = 0.01) -> DataFrame:
    """``(column, statistic, p_value, equality)``: two-sample Kolmogorov-Smirnov with the asymptotic p-value."""
    out = steps_of(pair, columns).groupBy("column").agg(F.max(_gap()).alias("statistic"), F.max("nr").alias("nr"), F.max("nf").alias("nf"))
    p = ks_p_value(F.col("statistic"), F.col("nr"), F.col("nf"))
    return out.select("column", "statistic", p.alias("p_value")).withColumn("equality", F.when(F.col("p_value") > p_value_threshold, "identical").otherwise("different"))


def ks_p_value(statistic: Column, nr: Column, nf: Column) -> Column:
    """The asymptotic p-value of a two-sample statistic."""
    n, m = nr.cast("double"), nf.cast("double")
    lam = F.sqrt(F.try_divide(n * m, n + m)) * statistic
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam))
    return F.when(lam < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def wasserstein_1d(pair: TablePair, columns: Sequence[str] | None = None, p: int = 1) -> DataFrame:
    """``(column, distance)``: the p-Wasserstein distance, p 1 or 2, of each column. Infinite values are an error."""
    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    if p == 1:
        return _finite(steps_of(pair, columns)).groupBy("column").agg(F.coalesce(F.sum(_gap() * (F.col("nxt") - F.col("value"))), F.lit(0.0)).alias("distance"))
    off = F.col("x") - F.col("y")
    return pieces_of(pair, columns).groupBy("column").agg(F.sqrt(F.coalesce(F.sum(F.col("width") * off * off), F.lit(0.0))).alias("distance"))


def pieces_of(pair: TablePair, columns: Sequence[str] | None = None, by_rank: bool = False) -> DataFrame:
    """The pair's ``quantile_pieces``, written once like ``steps_of``."""
    own = tuple(columns or pair.numerical)
    return pair.once(("pieces", own, by_rank), lambda: quantile_pieces(steps_of(pair, own) if by_rank else _finite(steps_of(pair, own)), by_rank))


def spreads(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, mean_r, mean_f, std_r, std_f, n_r, n_f)``."""
    r, f = F.when(F.col("side") == 1, F.col("value")), F.when(F.col("side") == 0, F.col("value"))
    return pair.long(columns).groupBy("column").agg(
        F.avg(r).alias("mean_r"), F.avg(f).alias("mean_f"), F.stddev_samp(r).alias("std_r"), F.stddev_samp(f).alias("std_f"), F.count(r).alias("n_r"), F.count(f).alias("n_f")
    )


def earth_movers_summary(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: mean, median, std, max, min of the distances, quality 1/(1+mean), similarity exp(-mean), worst column, mean normalised distance, rating."""
    each = wasserstein_1d(pair, columns).join(F.broadcast(spreads(pair, columns)), "column")
    each = each.withColumn("normalised", F.col("distance") / (F.coalesce("std_r", F.lit(0.0)) + F.coalesce("std_f", F.lit(0.0)) + 1e-10))
    out = each.agg(
        F.avg("distance").alias("mean_distance"), F.percentile("distance", F.lit(0.5)).alias("median_distance"), F.stddev_pop("distance").alias("std_distance"),
        F.max("distance").alias("max_distance"), F.min("distance").alias("min_distance"), F.max_by("column", F.struct("distance", "column")).alias("worst_column"), F.avg("normalised").alias("mean_normalised"),
    )
    mean = F.col("mean_distance")
    return out.withColumns({"quality": 1 / (1 + mean), "similarity": F.exp(-mean), "rating": WASSERSTEIN.column(mean)})


def bin_counts(pair: TablePair, columns: Sequence[str] | None = None, bins: int = 25) -> DataFrame:
    """``(column, bin, a, b)`` over equal, right-closed bins of the real side's range; values outside are left out.

    The lowest edge is a thousandth of the range lower. There are as many bins as
    real values, ``bins`` at most.
    """
    long = pair.long(columns)
    r = F.when(F.col("side") == 1, F.col("value"))
    edges = long.groupBy("column").agg(F.min(r).alias("lo"), F.max(r).alias("hi"), F.least(F.lit(bins), F.count(r).cast("int")).alias("k")).where("k > 0")
    flat = F.col("hi") == F.col("lo")
    pad = F.when(F.col("lo") != 0, 0.001 * F.abs("lo")).otherwise(F.lit(0.001))
    edges = edges.withColumns({"lo": F.when(flat, F.col("lo") - pad).otherwise(F.col("lo")), "hi": F.when(flat, F.col("hi") + pad).otherwise(F.col("hi"))})
    step = (F.col("hi") - F.col("lo")) / F.col("k")
    at = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.when(i == 0, F.col("lo") - F.when(flat, 0.0).otherwise(0.001 * (F.col("hi") - F.col("lo")))).when(i == F.col("k"), F.col("hi")).otherwise(F.col("lo") + i * step))
    edges = edges.select("column", "k", at.alias("edges"))
    placed = long.join(F.broadcast(edges), "column").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value"))))
    return placed.where("bin between 1 and k").groupBy("column", "bin").agg(F.sum("side").cast("long").alias("a"), F.sum(1 - F.col("side")).cast("long").alias("b"))


def js_distance(pair: TablePair, columns: Sequence[str] | None = None, bins: int = 25) -> DataFrame:
    """``(column, js_distance)``: the square root of the Jensen-Shannon divergence in nats; null if nothing of the fake side is in range."""
    whole = Window.partitionBy("column")  # 25 rows a column
    shares = bin_counts(pair, columns, bins).select("column", F.try_divide(F.col("a").cast("double"), F.sum("a").over(whole)).alias("p"), F.try_divide(F.col("b").cast("double"), F.sum("b").over(whole)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.ln(x / m)).when(x.isNotNull(), F.lit(0.0))
    return shares.groupBy("column").agg(F.sqrt(F.greatest((F.sum(term(F.col("p"))) + F.sum(term(F.col("q")))) / 2, F.lit(0.0))).alias("js_distance"))


def _histograms(pair: TablePair, columns: Sequence[str] | None, bins: int) -> DataFrame:
    """``(column, bin, low, width, p, q)``: both sides' shares over ``bins`` equal bins of both sides' range, empty ones left out."""
    long = pair.long(columns)
    span = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("side").alias("nr"), F.sum(1 - F.col("side")).alias("nf"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("value") - F.col("lo"), width)).cast("int"))
    placed = long.join(F.broadcast(span), "column").withColumn("bin", F.coalesce(bin_, F.lit(0)))
    share = lambda n, x: F.coalesce(F.try_divide(F.sum(x).cast("double"), F.col(n).cast("double")), F.lit(0.0))
    shares = placed.groupBy("column", "bin", "lo", "hi", "nr", "nf").agg(share("nr", F.col("side")).alias("p"), share("nf", 1 - F.col("side")).alias("q"))
    return shares.select("column", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), width.alias("width"), "p", "q")


def transport_plan(pair: TablePair, columns: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """``(column, source, target, source_low, target_low, mass, cost)``: which share of a real bin goes to which fake one in the cheapest plan.

    In one dimension that plan keeps the order: bins meet where their cumulative shares do.
    """
    shares = _histograms(pair, columns, bins)
    over = Window.partitionBy("column").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # 50 rows a column
    ends = shares.select("column", "bin", "low", "width", F.sum("p").over(over).alias("up"), F.sum("q").over(over).alias("uq"), "p", "q")
    a = ends.where("p > 0").select("column", F.col("bin").alias("source"), F.col("low").alias("source_low"), "width", (F.col("up") - F.col("p")).alias("p0"), F.col("up").alias("p1"))
    b = ends.where("q > 0").select("column", F.col("bin").alias("target"), F.col("low").alias("target_low"), (F.col("uq") - F.col("q")).alias("q0"), F.col("uq").alias("q1"))
    mass = F.least("p1", "q1") - F.greatest("p0", "q0")
    met = a.join(F.broadcast(b), "column").withColumn("mass", mass).where("mass > 1e-12")
    return met.select("column", "source", "target", "source_low", "target_low", "mass", (F.col("mass") * F.abs(F.col("source") - F.col("target")) * F.col("width")).alias("cost"))


def transport_cost(pair: TablePair, columns: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """``(column, cost)``: the cheapest way to move one histogram onto the other, over ``bins`` equal bins of both sides' range."""
    shares = _histograms(pair, columns, bins).withColumn("d", F.col("p") - F.col("q"))
    over = Window.partitionBy("column").orderBy("bin")  # 50 rows a column
    moved = shares.select("column", "width", F.abs(F.sum("d").over(over.rowsBetween(Window.unboundedPreceding, 0))).alias("c"), (F.coalesce(F.lead("bin").over(over), F.col("bin") + 1) - F.col("bin")).alias("steps"))
    return moved.groupBy("column").agg(F.sum(F.col("c") * F.col("width") * F.col("steps")).alias("cost"))


def sinkhorn(x: np.ndarray, y: np.ndarray, reg: float = 0.1, max_iter: int = 1000, tolerance: float = 1e-6) -> tuple[float, bool]:
    """Entropic transport cost between two point sets with equal weights, in the log domain; ``reg`` is relative to the mean cost."""
    cost = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    scale = cost.mean()
    if scale == 0:
        return 0.0, True
    k = -cost / (reg * scale)
    la, lb = -math.log(len(x)), -math.log(len(y))
    f, g = np.zeros(len(x)), np.zeros(len(y))

    if k.min() > -500:  # no weight underflows: products of matrices do
        kernel = np.exp(k)
        u, v, done = np.ones(len(x)), np.ones(len(y)), False
        for _ in range(max_iter):
            u = 1 / len(x) / (kernel @ v)
            new = 1 / len(y) / (kernel.T @ u)
            done = np.abs(np.log(new / v)).max() < tolerance
            v = new
            if done:
                break
        return float((u[:, None] * kernel * v[None, :] * cost).sum()), bool(done)

    def logsum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    done = False
    for _ in range(max_iter):
        f = la - logsum(k + g[None, :], 1)
        new = lb - logsum(k + f[:, None], 0)
        done = np.abs(new - g).max() < tolerance
        g = new
        if done:
            break
    plan = np.exp(k + f[:, None] + g[None, :])
    return float((plan * cost).sum()), bool(done)


def wasserstein_2d(pair: TablePair, columns: Sequence[str] | None = None, max_samples: int = 2000, reg: float = 0.1) -> DataFrame:
    """``(column, distance, converged, n_real, n_fake)`` of all pairs of columns, named ``a__b``: columns scaled by the real side, ``max_samples`` rows a side by hash order."""
    own = list(columns or pair.numerical)
    pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
    complete = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in own]).na.drop()
    from ..pair import row_key

    take = lambda df: complete(df).orderBy(row_key(own, pair.seed)).limit(max_samples)
    rows = take(pair.real).withColumn("side", F.lit(1)).unionByName(take(pair.fake).withColumn("side", F.lit(0)))
    stats = pair.real.agg(*[F.avg(c).alias(f"m_{c}") for c in own], *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in own])
    rows = rows.join(F.broadcast(stats))
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")
    exploded = rows.select("side", F.explode(F.array(*[F.struct(F.lit(f"{a}__{b}").alias("column"), z(a).alias("x"), z(b).alias("y")) for a, b in pairs])).alias("e")).select("e.column", "side", "e.x", "e.y")

    def solve(pdf):
        import pandas as pd

        p, q = pdf[pdf.side == 1][["x", "y"]].to_numpy(), pdf[pdf.side == 0][["x", "y"]].to_numpy()
        value, ok = sinkhorn(p, q, reg) if len(p) and len(q) else (float("nan"), False)
        return pd.DataFrame({"column": [pdf.column.iloc[0]], "distance": [value], "converged": [ok], "n_real": [len(p)], "n_fake": [len(q)]})

    return exploded.groupBy("column").applyInPandas(solve, "column string, distance double, converged boolean, n_real long, n_fake long")


def wasserstein_table(pair: TablePair, columns: Sequence[str] | None = None, p: int = 1, method: str = "1d", max_samples: int = 2000) -> DataFrame:
    """``(column, wasserstein_distance, method)``."""
    if method == "1d":
        return wasserstein_1d(pair, columns, p).select("column", F.col("distance").alias("wasserstein_distance"), F.lit(f"1D_p{p}").alias("method"))
    if method == "2d":
        return wasserstein_2d(pair, columns, max_samples).select("column", F.col("distance").alias("wasserstein_distance"), F.lit("2D_sinkhorn").alias("method"))
    raise ValueError("method must be 1d or 2d")
