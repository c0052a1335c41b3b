"""Association between columns, from one contingency table for all pairs of columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, correlation, weighted_correlation, weighted_correlations
from ..pair import TablePair, is_numeric
from .dist import ecdf, merged, pieces_of
from .ordered import ordered

EPSILON = 1e-10
#: Rows of a Kendall range, and the most levels (two to that power of ranges).
LEAF_ROWS = 50_000
MAX_LEVELS = 10


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]], weight: str | None = None) -> DataFrame:
    """``(col_a, col_b, a, b, n)`` of all pairs in one pass, a row counting ``weight`` times; rows with a null in the pair are left out."""
    text = lambda c: F.col(c).cast("string")
    parts = F.array(*[F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), text(x).alias("a"), text(y).alias("b")) for x, y in pairs])
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    each = df.select(times.alias("times"), F.explode(parts).alias("e")).select("times", "e.*").where("a is not null and b is not null")
    return each.groupBy("col_a", "col_b", "a", "b").agg(F.sum("times").alias("n"))


def _margins(table: DataFrame) -> DataFrame:
    """``table`` with the totals ``na``, ``nb``, ``t`` of row, column and pair, by aggregates that combine before they shuffle."""
    key = ["col_a", "col_b"]
    rows = table.groupBy(*key, "a").agg(F.sum("n").alias("na"))
    columns = table.groupBy(*key, "b").agg(F.sum("n").alias("nb"))
    total = table.groupBy(*key).agg(F.sum("n").alias("t"))
    return table.join(rows, [*key, "a"]).join(columns, [*key, "b"]).join(F.broadcast(total), key)


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]], bias_correction: bool = True, weight: str | None = None) -> DataFrame:
    """``(col_a, col_b, value)``: Cramér's V without Yates; 0 for a table of one row or column."""
    cells = _margins(contingency(df, pairs, weight))
    d = lambda c: F.col(c).cast("double")
    sums = cells.groupBy("col_a", "col_b").agg(
        F.max("t").cast("double").alias("t"), F.countDistinct("a").cast("double").alias("r"), F.countDistinct("b").cast("double").alias("k"),
        F.sum(d("n") * d("n") / (d("na") * d("nb"))).alias("s"),
    )
    phi = F.greatest(F.col("s") - 1, F.lit(0.0))
    k, r, t = F.col("k"), F.col("r"), F.col("t")
    if bias_correction:
        phi2 = F.greatest(F.lit(0.0), phi - F.coalesce(F.try_divide((k - 1) * (r - 1), t - 1), F.lit(0.0)))
        low = F.least(k - F.coalesce(F.try_divide((k - 1) * (k - 1), t - 1), F.lit(0.0)), r - F.coalesce(F.try_divide((r - 1) * (r - 1), t - 1), F.lit(0.0))) - 1
    else:
        phi2, low = phi, F.least(k, r) - 1
    value = F.when((k < 2) | (r < 2) | (low <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.sqrt(F.coalesce(F.try_divide(phi2, low), F.lit(0.0)))))
    return sums.select("col_a", "col_b", value.alias("value"))


def theils_u(df: DataFrame, pairs: Sequence[tuple[str, str]], weight: str | None = None) -> DataFrame:
    """``(col_a, col_b, value)``: how much of col_a's entropy col_b explains; 0 if col_a is constant."""
    cells = _margins(contingency(df, pairs, weight))
    d = lambda c: F.col(c).cast("double")
    log = lambda p: F.log2(p + EPSILON)
    sums = cells.groupBy("col_a", "col_b").agg(
        # the entropy of a, each cell with its share of the row
        (-F.sum(d("n") / d("t") * log(d("na") / d("t")))).alias("hx"),
        (-F.sum(d("n") / d("t") * log(d("n") / d("nb")))).alias("hxy"),
        F.countDistinct("a").alias("k"),
    )
    value = F.when(F.col("k") < 2, F.lit(0.0)).otherwise(clamp(F.coalesce(F.try_divide(F.col("hx") - F.col("hxy"), F.col("hx")), F.lit(0.0)), 0.0, 1.0))
    return sums.select("col_a", "col_b", value.alias("value"))


def correlation_ratio(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(col_a, col_b, value)``: eta of a categorical col_a and a numerical col_b."""
    parts = F.array(*[F.struct(F.lit(c).alias("col_a"), F.lit(x).alias("col_b"), F.col(c).cast("string").alias("g"), F.col(x).cast("double").alias("v")) for c, x in pairs])
    each = df.select(F.explode(parts).alias("e")).select("e.*").where("g is not null and v is not null and not isnan(v)")
    groups = each.groupBy("col_a", "col_b", "g").agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    over = Window.partitionBy("col_a", "col_b")
    groups = groups.withColumn("all", F.sum(F.col("n") * F.col("m")).over(over) / F.sum("n").over(over))
    out = groups.groupBy("col_a", "col_b").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("all"), F.lit(2.0))).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"), F.count("*").alias("k"))
    eta = F.sqrt(F.coalesce(F.try_divide(F.col("between"), F.col("between") + F.col("within")), F.lit(0.0)))
    return out.select("col_a", "col_b", F.when(F.col("k") < 2, F.lit(0.0)).otherwise(clamp(eta, 0.0, 1.0)).alias("value"))


def _numeric_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")) for x, y in pairs])
    return df.select(F.explode(parts).alias("e")).select("e.*").where("a is not null and b is not null and not isnan(a) and not isnan(b)")


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(col_a, col_b, value)``, signed; 0 if a column is constant."""
    return _numeric_pairs(df, pairs).groupBy("col_a", "col_b").agg(F.coalesce(correlation("a", "b"), F.lit(0.0)).alias("value"))


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]], absolute: bool = True) -> DataFrame:
    """``(col_a, col_b, value)`` from mean ranks of ties, over the rows that are complete in the pair."""
    both = _numeric_pairs(df, pairs).groupBy("col_a", "col_b", "a", "b").agg(F.count("*").alias("n"))
    key = F.concat_ws("\x01", "col_a", "col_b")

    def ranks(value: str) -> DataFrame:
        long = _numeric_pairs(df, pairs).select(key.alias("column"), F.lit(1).alias("side"), F.col(value).alias("value"))
        # the mean of all ranks is (n + 1) / 2: taken off, so that sums of squares keep their digits
        return ecdf(long).select(F.col("column").alias(f"k_{value}"), F.col("value").alias(f"v_{value}"), (F.col("cr") - F.col("a") / 2.0 - F.col("nr") / 2.0).alias(f"rank_{value}"))

    joined = both.withColumn("key", key)
    for v in ("a", "b"):
        joined = joined.join(ranks(v), (F.col("key") == F.col(f"k_{v}")) & (F.col(v) == F.col(f"v_{v}")))
    value = F.coalesce(weighted_correlation("rank_a", "rank_b", "n"), F.lit(0.0))
    return joined.groupBy("col_a", "col_b").agg((F.abs(value) if absolute else value).alias("value"))


def _agreement(a, b, n) -> float:
    """Concordant less discordant pairs of the cells ``(a, b)`` that occur ``n`` times."""
    import numpy as np

    order = np.argsort(a, kind="stable")
    x, y = (np.unique(c, return_inverse=True)[1][order] for c in (a, b))
    w = np.asarray(n, dtype=np.float64)[order]
    total, todo = 0.0, [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 or x[lo] == x[hi - 1]:
            continue
        if hi - lo <= 256:
            u, v, k = x[lo:hi], y[lo:hi], w[lo:hi]
            total += float((np.sign(u[:, None] - u) * np.sign(v[:, None] - v) * (k[:, None] * k)).sum()) / 2
            continue
        middle = x[(lo + hi) // 2]
        cut = int(np.searchsorted(x, middle, "left"))
        if cut <= lo:
            cut = int(np.searchsorted(x, middle, "right"))
        above = np.argsort(y[cut:hi])
        values, sums = y[cut:hi][above], np.append(0.0, np.cumsum(w[cut:hi][above]))
        below, upto = (sums[np.searchsorted(values, y[lo:cut], side)] for side in ("left", "right"))
        total += float((w[lo:cut] * (sums[-1] - upto - below)).sum())
        todo += [(lo, cut), (cut, hi)]
    return total


def kendall(df: DataFrame, pairs: Sequence[tuple[str, str]], max_samples: int | None = None, seed: int = 42, absolute: bool = True, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(col_a, col_b, value)``: tau-b over all rows, or over ``max_samples`` rows by hash order if that is given.

    The first column's values are cut into ranges of about ``leaf_rows`` rows, equal
    values together. Pairs of rows inside a range are counted in one task; pairs of
    rows of two ranges at the bit where the ranges' numbers first differ, from the
    second column's cumulative counts on either side of that bit.
    """
    from ..pair import row_key

    spark = df.sparkSession
    own = sorted({c for p in pairs for c in p})
    rows = df.select(*own)
    if max_samples is not None:
        rows = rows.orderBy(row_key(own, seed)).limit(max_samples)
    each = _numeric_pairs(rows, pairs)
    key = ["col_a", "col_b"]
    most = max([r["count"] for r in each.groupBy(*key).count().collect()], default=0)  # a row a pair
    levels = min(MAX_LEVELS, max(0, (-(-most // leaf_rows) - 1).bit_length()))
    if levels:
        steps = F.array(*[F.lit(i / (1 << levels)) for i in range(1, 1 << levels)])
        # collected, so that all that follows sees the same cut points: 2**MAX_LEVELS a pair at most
        cuts = each.groupBy(*key).agg(F.percentile_approx("a", steps, F.lit(10_000)).alias("cuts")).collect()
        cuts = spark.createDataFrame([tuple(r) for r in cuts], "col_a string, col_b string, cuts array<double>")
        each = each.join(F.broadcast(cuts), key).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("a")))).drop("cuts")
    else:
        each = each.withColumn("range", F.lit(0))
    cells = each.groupBy(*key, "range", "a", "b").agg(F.count("*").alias("n"))

    def inside(name, pdf):
        import pandas as pd

        return pd.DataFrame([(*name[:2], _agreement(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy()))], columns=["col_a", "col_b", "s"])

    agree = cells.groupBy(*key, "range").applyInPandas(inside, "col_a string, col_b string, s double")
    if levels:
        level = each.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
        name = F.concat_ws("\x01", *key, F.col("level").cast("string"), F.expr("shiftright(range, level + 1)").cast("string"))
        long = level.select(name.alias("column"), F.expr("1 - (shiftright(range, level) & 1)").alias("side"), F.col("b").alias("value"))
        d = lambda c: F.col(c).cast("double")
        part = F.split("column", "\x01")
        across = ecdf(long).select(part[0].alias("col_a"), part[1].alias("col_b"), (d("a") * (d("nf") - 2 * d("cf") + d("b"))).alias("s"))
        agree = agree.unionByName(across)
    agree = agree.groupBy(*key).agg(F.sum("s").alias("s"))

    def untied(column: str) -> DataFrame:
        ties = cells.groupBy(*key, column).agg(F.sum("n").cast("double").alias("t"))
        sums = ties.groupBy(*key).agg(F.sum("t").alias("t"), F.sum(F.col("t") * (F.col("t") - 1)).alias("same"))
        return sums.select(*key, ((F.col("t") * (F.col("t") - 1) - F.col("same")) / 2).alias(f"untied_{column}"))

    joined = agree.join(untied("a"), key).join(untied("b"), key)
    value = F.coalesce(F.try_divide(F.col("s"), F.sqrt("untied_a") * F.sqrt("untied_b")), F.lit(0.0))
    return joined.select(*key, (F.abs(value) if absolute else value).alias("value"))


def nominal(df: DataFrame, choice: str | Sequence[str] | None = "auto") -> list[str]:
    """The nominal columns: ``auto`` takes all that aren't numbers, ``all`` all, None none."""
    if choice is None:
        return []
    if choice == "all":
        return list(df.columns)
    if choice == "auto":
        return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    return [c for c in df.columns if c in set(choice)]


def associations(df: DataFrame, nominal_columns: str | Sequence[str] | None = "auto", nom_nom: str = "cramer", num_num: str = "pearson") -> DataFrame:
    """``(col_a, col_b, value)``: the whole matrix in long form, diagonal 1; what can't be computed is 0."""
    cats = nominal(df, nominal_columns)
    nums = [c for c in df.columns if c not in cats]
    order = {c: i for i, c in enumerate(df.columns)}
    upper = lambda own: [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
    parts: list[DataFrame] = []
    mirrored: list[DataFrame] = []
    if len(cats) > 1:
        if nom_nom == "theil":
            parts.append(theils_u(df, [(a, b) for a in cats for b in cats if a != b]))
        elif nom_nom == "cramer":
            mirrored.append(cramers_v(df, upper(cats)))
        else:
            raise ValueError("nom_nom must be cramer or theil")
    if len(nums) > 1:
        how = {"pearson": pearson, "spearman": spearman, "kendall": kendall}
        if num_num not in how:
            raise ValueError(f"num_num must be one of {sorted(how)}")
        mirrored.append(how[num_num](df, upper(nums)))
    if cats and nums:
        mirrored.append(correlation_ratio(df, [(c, x) for c in cats for x in nums]))
    for m in mirrored:
        both = F.explode(F.array(F.struct("col_a", "col_b", "value"), F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "value")))
        parts.append(m.select(both.alias("e")).select("e.*"))
    frame = df.sparkSession.createDataFrame([(a, b, 1.0 if a == b else 0.0) for a in order for b in order], "col_a string, col_b string, fallback double")
    if not parts:
        return frame.select("col_a", "col_b", F.col("fallback").alias("value"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return frame.join(F.broadcast(found), ["col_a", "col_b"], "left").select("col_a", "col_b", F.coalesce("value", "fallback").alias("value"))


def association_pair(pair: TablePair, nom_nom: str = "theil", columns: Sequence[str] | None = None) -> DataFrame:
    """``(col_a, col_b, real, fake, difference)`` of both sides' matrices."""
    own = list(columns or pair.real.columns)
    cats = [c for c in pair.categorical if c in own]
    side = lambda df, name: associations(df.select(*own), cats, nom_nom).withColumnRenamed("value", name)
    both = side(pair.real, "real").join(F.broadcast(side(pair.fake, "fake")), ["col_a", "col_b"])
    return both.withColumn("difference", F.abs(F.col("real") - F.col("fake")))


def correlation_distance(pair: TablePair, how: str = "euclidean", table: DataFrame | None = None) -> DataFrame:
    """One row ``(how, distance)`` between both sides' Theil matrices, the diagonal included."""
    from ..functions import scalar

    ways: dict[str, Column] = {
        "euclidean": scalar.euclidean_distance("real", "fake"),
        "mae": scalar.mean_absolute_error("real", "fake"),
        "rmse": scalar.rmse("real", "fake"),
        "cosine": 1 - scalar.cosine_similarity("real", "fake"),
    }
    if how not in ways:
        raise ValueError(f"how must be one of {sorted(ways)}")
    table = association_pair(pair) if table is None else table
    return table.agg(F.lit(how).alias("how"), ways[how].alias("distance")).select("how", "distance")


def correlation_correlation(pair: TablePair, table: DataFrame | None = None) -> DataFrame:
    """One row ``(correlation)``: Pearson between the off-diagonal entries of both Theil matrices."""
    table = association_pair(pair) if table is None else table
    return table.where("col_a <> col_b").agg(F.coalesce(correlation("real", "fake"), F.lit(0.0)).alias("correlation"))


def column_correlations(pair: TablePair, theil: bool = True) -> DataFrame:
    """``(column, correlation)``: sorted real against sorted fake values (numbers), real against fake row by row in key order (categories).

    Numbers are paired by their rank among the non-missing values; categories by
    the order of all columns' values on each side, so that the result doesn't
    depend on how rows are stored. Surplus rows of the longer side have no partner.
    """
    out: DataFrame | None = None
    if pair.numerical:
        # equal ranks meet: both sides' values over the ranks, a piece wherever either changes
        out = weighted_correlations(pieces_of(pair, by_rank=True), "column", "x", "y", "width")
    cats = [c for c in pair.categorical if c not in pair.text]
    if cats:
        number = lambda df, side: _numbered(df.select(*[F.col(c).cast("string").alias(f"{side}_{c}") for c in cats]))
        r, f = number(pair.real, "r"), number(pair.fake, "f")
        size = lambda df: df.agg(F.coalesce(F.max("hi"), F.lit(0)).alias("n"))
        most = size(r).unionByName(size(f)).agg(F.min("n").cast("double").alias("most"))
        none, at = F.lit(None).cast("double"), lambda c: F.col(c).cast("double")
        real = r.select(F.lit("rows").alias("column"), at("hi").alias("u"), at("lo").alias("x"), none.alias("y"))
        fake = f.select(F.lit("rows").alias("column"), at("hi").alias("u"), none.alias("x"), at("lo").alias("y"))
        pieces = merged(real.unionByName(fake).join(F.broadcast(most)))
        both = pieces.join(r.withColumn("x", at("lo")).drop("lo", "hi"), "x").join(f.withColumn("y", at("lo")).drop("lo", "hi"), "y")
        pairs = [(f"r_{c}", f"f_{c}") for c in cats]
        found = theils_u(both, pairs, "width") if theil else cramers_v(both, pairs, weight="width")
        named = found.select(F.substring("col_a", 3, 1000).alias("column"), F.col("value").alias("correlation"))
        out = named if out is None else out.unionByName(named)
    if out is None:
        raise ValueError("the pair has no columns")
    return out


def _numbered(df: DataFrame) -> DataFrame:
    """``(lo, hi, ...)``: the distinct rows of ``df``, and which places their copies take, ``lo`` to before ``hi``, if it is put in the order of all columns."""
    own = list(df.columns)
    # equal rows are one row with its number of copies: a row that fills a third of a table is in one range, once
    counted = df.groupBy(*own).agg(F.count("*").alias("copies"))
    rows = ordered(counted, [], own, lambda s: {"upto": np.cumsum(s["copies"])}, "upto long", "numbered")
    sizes = rows.groupBy("part").agg(F.sum("copies").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shift = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("from"))
    last = F.col("from") + F.col("upto")
    return rows.join(F.broadcast(shift), "part").select((last - F.col("copies")).alias("lo"), last.alias("hi"), *own)
