"""Numeric encodings of categorical columns, fitted on the union of both sides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..pair import TablePair, common_columns, digest, is_numeric
from ..work import materialize
from .ordered import ordered

__all__ = ["code_table", "codes", "common_columns", "encode_features", "factorize", "numeric_encoding", "one_hot"]

#: Most values of a one-hot column: each becomes a column of the result, and a plan can't hold more.
MAX_COLUMNS = 100_000
#: Characters of a value that are compared first, and how many times as many each time that doesn't tell values apart.
HEAD, LONGER = 64, 16
#: Most digests that are broadcast.
MOST_KEYS = 1 << 16


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def _values(both: DataFrame, cats: Sequence[str]) -> DataFrame:
    """``(c, v)``: the distinct values of each column."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cats]))
    return both.select(each.alias("e")).select("e.*").where("v is not null").distinct()


def code_table(pair: TablePair, cats: Sequence[str]) -> DataFrame:
    """``(c, v, code)``: the 0-based place of each value among the sorted values of its column, over both sides; a written table of any size."""
    return _code_table(pair.tagged(cats), cats)


def _code_table(both: DataFrame, cats: Sequence[str]) -> DataFrame:
    return _places(_values(both, cats), "v")


def _places(values: DataFrame, by: str) -> DataFrame:
    """``(c, v, code)`` of distinct ``values``: the place of ``v`` in its column by the order of ``by``."""
    found = ordered(values, ["c"], [by], lambda s: {"at": s.running(np.ones(s.table.num_rows, np.int64))}, "at long", "codes")
    sizes = found.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shift = sizes.select("c", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    return found.join(F.broadcast(shift), ["c", "part"]).select("c", "v", (F.col("from") + F.col("at") - 1).cast("int").alias("code"))


def codes(pair: TablePair, cats: Sequence[str]) -> dict[str, list[str]]:
    """The sorted values of columns that become columns themselves, one job for all."""
    rows = _values(pair.tagged(cats), cats).limit(MAX_COLUMNS * len(cats) + 1).collect()
    out: dict[str, list[str]] = {c: [] for c in cats}
    for r in rows:
        out[r["c"]].append(r["v"])
    for c, values in out.items():
        if len(values) > MAX_COLUMNS:
            raise ValueError(f"column {c} has more than {MAX_COLUMNS} values; factorize it instead")
        values.sort()
    return out


def factorize(pair: TablePair, cats: Sequence[str] | None = None) -> TablePair:
    """Categories as integers, null as null. Equal codes mean equal values on both sides.

    The codes are a table that is joined; Spark broadcasts it if it is small.
    """
    cats = list(cats if cats is not None else categorical_columns(pair.real))
    if not cats:
        return pair
    table = code_table(pair, cats)
    return replace(pair, real=_coded(pair.real, table, cats), fake=_coded(pair.fake, table, cats))


def _coded(df: DataFrame, table: DataFrame, cats: Sequence[str]) -> DataFrame:
    for c in cats:
        own = table.where(F.col("c") == c).select(F.col("v").alias("__value"), F.col("code").alias("__code"))
        df = df.join(own, F.col(f"`{c}`").cast("string") == F.col("__value"), "left").withColumn(c, F.col("__code")).drop("__value", "__code")
    return df


def coded(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Columns of one table as codes of their sorted values, null as null; codes don't reach the driver.

    Values are told apart by digests and sorted by as much of their beginnings as
    differs, so that whole texts are neither shuffled nor sampled for ranges.
    """
    if not cats:
        return df
    return _coded(df.withColumns({c: digest(c) for c in cats}), _places(_heads(df, cats), "head"), cats)


def _heads(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """``(c, v, head)``, a row a distinct value: its digest, and a beginning that is no other value's, ``HEAD`` characters or, where those are shared, ``LONGER`` times as many, and so on.

    Heads are ordered as the values are: two differ within the shorter one, or that is a whole value.
    """
    out: DataFrame | None = None
    size, shared = HEAD, None
    while True:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), digest(c).alias("v"), F.substring(F.col(f"`{c}`").cast("string"), 1, size).alias("head")) for c in cats]))
        rows = df.select(each.alias("e")).select("e.*").where("v is not null")
        if shared is not None:
            rows = rows.join(shared, ["c", "v"], "left_semi")
        rows = rows.distinct()
        times = rows.groupBy("c", "head").agg(F.count("*").alias("n"))
        rows = materialize(rows.join(times, ["c", "head"]).select("c", "v", "head", (F.col("n") > 1).alias("shared")), "heads")
        own = rows.where("not shared").select("c", "v", "head")
        out = own if out is None else out.unionByName(own)
        n = rows.where("shared").count()
        if not n:
            return out
        shared = rows.where("shared").select("c", "v")
        shared = F.broadcast(shared) if n <= MOST_KEYS else shared
        size = min(size * LONGER, (1 << 31) - 1)


def one_hot(pair: TablePair, cats: Sequence[str] | None = None) -> TablePair:
    """A double column ``column_value`` for each value of either side, other columns as doubles, all sorted by name."""
    cats = list(cats if cats is not None else categorical_columns(pair.real))
    known = codes(pair, cats) if cats else {}
    made = {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for c in cats for v in known[c]}
    made |= {c: F.col(c).cast("double") for c in pair.real.columns if c not in cats}
    columns = [made[name].alias(name) for name in sorted(made)]
    return replace(pair, real=pair.real.select(*columns), fake=pair.fake.select(*columns), numerical=tuple(sorted(made)), categorical=())


def numeric_encoding(pair: TablePair, cats: Sequence[str] | None = None, drop_single_label: bool = False, nan_strategy: str = "replace", nan_replace_value: float = 0.0) -> tuple[TablePair, dict[str, str]]:
    """Both sides as numbers, and what became of each categorical column.

    One value over both sides: ``constant`` 0 or dropped; two: ``factorized``;
    more: ``one_hot``. Missing numbers: ``replace``, ``drop_samples`` or ``drop_features``.
    """
    cats = list(cats if cats is not None else categorical_columns(pair.real))
    nums = [c for c in pair.real.columns if c not in cats]
    real, fake = pair.real, pair.fake
    if nan_strategy == "replace":
        fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(nan_replace_value))) for c in nums}
        real, fake = (df.withColumns(fill) if fill else df for df in (real, fake))
    elif nan_strategy == "drop_samples":
        real, fake = real.na.drop(), fake.na.drop()
    elif nan_strategy == "drop_features":
        missing = pair.tagged().agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in pair.real.columns]).first()
        gone = [c for c in pair.real.columns if missing[c]]
        real, fake = real.drop(*gone), fake.drop(*gone)
        cats, nums = [c for c in cats if c not in gone], [c for c in nums if c not in gone]
    else:
        raise ValueError("nan_strategy must be replace, drop_samples or drop_features")
    own = replace(pair, real=real, fake=fake)
    known = codes(own, cats) if cats else {}
    info: dict[str, str] = {}
    columns = [F.col(c).cast("double").alias(c) for c in nums]
    names = list(nums)
    for c in cats:
        values = known[c]
        if len(values) <= 1:
            info[c] = "dropped" if drop_single_label else "constant"
            made = [] if drop_single_label else [(c, F.lit(0.0))]
        elif len(values) == 2:
            info[c], made = "factorized", [(c, F.when(F.col(c).isNull(), -1.0).otherwise((F.col(c).cast("string") == values[1]).cast("double")))]
        else:
            info[c] = "one_hot"
            made = [(f"{c}_{v}", F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0))) for v in values]
        columns += [x.alias(n) for n, x in made]
        names += [n for n, _ in made]
    return replace(own, real=real.select(*columns), fake=fake.select(*columns), numerical=tuple(names), categorical=()), info


def encode_features(df: DataFrame, cats: Sequence[str] | None = None) -> DataFrame:
    """String columns of one table as codes of their sorted values."""
    return factorize(TablePair.of(df, df), cats).real
