"""The data behind the plots, as tables; drawing is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..pair import MISSING, TablePair
from .assoc import association_pair
from .basic import pca_projection
from .dist import spreads, steps_of

SMALL = 1e-5


def mean_std(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, log_mean_real, log_mean_fake, log_std_real, log_std_fake)``."""
    log = lambda c: F.ln(F.abs(F.coalesce(F.col(c), F.lit(0.0))) + SMALL)
    return spreads(pair, columns).select("column", log("mean_r").alias("log_mean_real"), log("mean_f").alias("log_mean_fake"), log("std_r").alias("log_std_real"), log("std_f").alias("log_std_fake"))


def cumulative(pair: TablePair, columns: Sequence[str] | None = None, points: int | None = None) -> DataFrame:
    """``(column, value, real, fake)``: both empirical distribution functions at each distinct value, or at about ``points`` of them."""
    steps = steps_of(pair, columns)
    out = steps.select("column", "value", (F.col("cr") / F.col("nr")).alias("real"), (F.col("cf") / F.col("nf")).alias("fake"), (F.col("cr") + F.col("cf")).alias("__c"), (F.col("a") + F.col("b")).alias("__n"), (F.col("nr") + F.col("nf")).alias("__t"))
    if points:
        at = lambda c: F.floor(c * points / F.col("__t"))
        out = out.where(at(F.col("__c")) > at(F.col("__c") - F.col("__n")))
    return out.drop("__c", "__n", "__t")


def histogram(pair: TablePair, columns: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """``(column, bin, low, real, fake)``: shares over equal bins of both sides' range, the last one closed; empty bins are left out."""
    long = pair.long(columns)
    span = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("side").cast("double").alias("nr"), F.sum(1 - F.col("side")).cast("double").alias("nf"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("value") - F.col("lo"), width)).cast("int")), F.lit(0))
    placed = long.join(F.broadcast(span), "column").withColumns({"bin": bin_, "low": F.col("lo") + bin_ * width})
    return placed.groupBy("column", "bin", "low", "nr", "nf").agg(F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b")).select(
        "column", "bin", "low", F.coalesce(F.try_divide(F.col("a"), F.col("nr")), F.lit(0.0)).alias("real"), F.coalesce(F.try_divide(F.col("b"), F.col("nf")), F.lit(0.0)).alias("fake")
    )


def density(pair: TablePair, columns: Sequence[str] | None = None, points: int = 200, cells: int = 2000) -> DataFrame:
    """``(column, at, real, fake)``: Gaussian kernel densities at ``points`` places over both sides' range, bandwidth std * n^(-1/5).

    Values are counted in ``cells`` equal cells first, so that what is compared with
    the points doesn't grow with the table.
    """
    long = pair.long(columns)
    own = spreads(pair, columns)
    span = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).join(F.broadcast(own), "column")
    wide = F.coalesce(F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1.0))
    span = span.select("column", "lo", wide.alias("wide"), *[(F.coalesce(F.nullif(F.col(f"std_{s}"), F.lit(0.0)), wide / cells) * F.pow(F.col(f"n_{s}").cast("double"), F.lit(-0.2))).alias(f"h_{s}") for s in "rf"], "n_r", "n_f")
    cell = F.least(F.lit(cells - 1), F.floor((F.col("value") - F.col("lo")) / F.col("wide") * cells)).cast("int")
    counted = long.join(F.broadcast(span), "column").groupBy("column", cell.alias("cell")).agg(F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b"))
    places = counted.join(F.broadcast(span), "column").withColumn("x", F.col("lo") + (F.col("cell") + 0.5) * F.col("wide") / cells)
    places = places.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("lo") + F.col("k") * F.col("wide") / (points - 1))
    bell = lambda h: F.exp(-0.5 * F.pow((F.col("at") - F.col("x")) / F.col(h), F.lit(2.0))) / (F.col(h) * (2 * math.pi) ** 0.5)
    share = lambda c, h, n: F.coalesce(F.sum(F.try_divide(F.col(c) * bell(h), F.col(n).cast("double"))), F.lit(0.0))
    return places.groupBy("column", "k", "at").agg(share("a", "h_r", "n_r").alias("real"), share("b", "h_f", "n_f").alias("fake")).select("column", "at", "real", "fake")


def category_shares(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, category, real, fake)``: shares over the union of categories; a missing value is ``[NAN]``."""
    own = list(columns or pair.categorical)
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("category")) for c in own])
    counts = pair.tagged(own).select("side", F.explode(parts).alias("e")).groupBy("e.column", "e.category").agg(F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b"))
    totals = counts.groupBy("column").agg(F.sum("a").cast("double").alias("nr"), F.sum("b").cast("double").alias("nf"))
    share = lambda x, n: F.coalesce(F.try_divide(F.col(x), F.col(n)), F.lit(0.0))
    return counts.join(F.broadcast(totals), "column").select("column", "category", share("a", "nr").alias("real"), share("b", "nf").alias("fake"))


def correlation_difference(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col_a, col_b, real, fake, difference)`` of Theil matrices."""
    return association_pair(pair, "theil", columns)


def several(pairs: dict[str, TablePair], make, **how) -> DataFrame:
    """``make(pair)`` for several pairs, with their names in ``pair``."""
    out: DataFrame | None = None
    for name, pair in pairs.items():
        part = make(pair, **how).withColumn("pair", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no pair given")
    return out


def pca_points(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    return pca_projection(pair, columns, k=2)


def grid(n_plots: int, n_columns: int) -> tuple[int, int]:
    """Rows and columns of a page that holds ``n_plots``."""
    n_columns = max(1, min(n_columns, n_plots))
    return -(-n_plots // n_columns), n_columns


def row_heights(df: DataFrame, columns: Sequence[str], base: float = 6.0, per_char: float = 0.2, free: int = 10) -> DataFrame:
    """``(column, longest, height)``: longest label of each column, and a plot height that leaves room for it."""
    longest = df.agg(*[F.coalesce(F.max(F.length(F.trim(F.col(c).cast("string")))), F.lit(0)).alias(c) for c in columns])
    each = longest.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("longest")) for c in columns])).alias("e")).select("e.*")
    return each.withColumn("height", F.lit(base) + F.greatest(F.col("longest") - free, F.lit(0)) * per_char)


def visual_evaluation(pair: TablePair, folder: str | None = None) -> dict[str, DataFrame]:
    """The tables of all five plots, written below ``folder`` if it is given."""
    from ..sources.files import write_report

    parts = {"mean_std": mean_std(pair), "cumulative": cumulative(pair, points=200), "histogram": histogram(pair)}
    if pair.categorical:
        parts["categories"] = category_shares(pair)
    parts["correlation_difference"] = correlation_difference(pair)
    if len(pair.numerical) > 1:
        parts["pca"] = pca_points(pair)
    if folder:
        write_report(parts, folder)
    return parts


