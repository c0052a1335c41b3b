"""A pair of tables with the same columns: the subject of every measure."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import materialize

SEED = 42
MISSING = "[NAN]"


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes null, so that both count as missing."""
    fixed = {f.name: F.when(F.isnan(F.col(f"`{f.name}`")), None).otherwise(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(fixed) if fixed else df


def row_key(columns: Iterable[str], seed: int = SEED) -> Column:
    """A reproducible pseudo-random key of a row's values: equal in any plan and in any engine that has md5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def digest(column: str) -> Column:
    """A value's SHA-256 as hex digits, null for null."""
    return F.sha2(F.col(f"`{column}`").cast("string"), 256)


def common_columns(real: DataFrame, fake: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to their common columns, sorted by name."""
    names = sorted(set(real.columns) & set(fake.columns))
    return real.select(*names), fake.select(*names)


@dataclass(frozen=True)
class TablePair:
    """``real`` and ``fake`` have the same columns in the same order. Roles are lists of column names; text is an overlay."""

    real: DataFrame
    fake: DataFrame
    numerical: tuple[str, ...]
    categorical: tuple[str, ...]
    text: tuple[str, ...] = ()
    seed: int = SEED
    name: str = ""
    notes: tuple[str, ...] = field(default=())
    #: Tables that several measures share, by what they are; a changed pair starts with none.
    kept: dict = field(init=False, default_factory=dict, compare=False, repr=False)

    def once[Made](self, what: Hashable, make: Callable[[], Made]) -> Made:
        """``make()`` the first time, the same table or pair from then on."""
        if what not in self.kept:
            self.kept[what] = make()
        return self.kept[what]

    @classmethod
    def of(cls, real: DataFrame, fake: DataFrame, cat_cols: Sequence[str] | None = None, text_cols: Sequence[str] = (), unique_thresh: int = 0, seed: int = SEED, name: str = "") -> TablePair:
        """Align, check and assign roles.

        ``cat_cols``, if given, is the categorical list, and all other columns are
        numerical. Else a number with more than ``unique_thresh`` distinct values
        (null counts as one) is numerical, and the rest is categorical.
        """
        if set(real.columns) != set(fake.columns):
            raise ValueError(f"columns differ: {sorted(set(real.columns) ^ set(fake.columns))}")
        for f in real.schema.fields:
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                raise TypeError(f"column {f.name} is nested; flatten it first")
        for c in [*(cat_cols or ()), *text_cols]:
            if c not in real.columns:
                raise ValueError(f"no column {c}")
        fake = fake.select(*real.columns)
        real, fake = no_nan(real), no_nan(fake)
        if cat_cols is not None:
            categorical = tuple(c for c in real.columns if c in set(cat_cols))
        else:
            numbers = [f.name for f in real.schema.fields if is_numeric(f.dataType)]
            few: set[str] = set()
            if unique_thresh > 0 and numbers:
                distinct = real.agg(*[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in numbers]).first()
                few = {c for c in numbers if (distinct[c] or 0) <= unique_thresh}
            categorical = tuple(c for c in real.columns if c not in numbers or c in few)
        return cls(real, fake, tuple(c for c in real.columns if c not in categorical), categorical, tuple(text_cols), seed, name)

    def tagged(self, columns: Sequence[str] | None = None) -> DataFrame:
        """Both tables as one, with ``side`` 1 for real and 0 for fake: one scan serves both."""
        own = list(columns or self.real.columns)
        return self.real.select(F.lit(1).alias("side"), *own).unionByName(self.fake.select(F.lit(0).alias("side"), *own))

    def long(self, columns: Sequence[str] | None = None) -> DataFrame:
        """``(column, side, value)`` of numerical columns as doubles, without missing values."""
        own = list(columns or self.numerical)
        if not own:
            raise ValueError("the pair has no numerical column")
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in own])
        return self.tagged(own).select("side", F.explode(pairs).alias("e")).select("e.column", "side", "e.value").where("value is not null and not isnan(value)")

    def stored(self) -> TablePair:
        """The pair read from one written table: what it was made of isn't joined again by each measure."""
        table = materialize(self.tagged(), "pair")
        side = lambda k: table.where(F.col("side") == k).select(*self.real.columns)
        return replace(self, real=side(1), fake=side(0))

    def digested(self) -> TablePair:
        """Texts as their SHA-256, equal where the texts are: measures that only compare whole values needn't move them."""
        texts = {c: digest(c) for c in self.text if isinstance(self.real.schema[c].dataType, T.StringType)}
        return replace(self, real=self.real.withColumns(texts), fake=self.fake.withColumns(texts)) if texts else self

    def sampled(self, n: int | None = None) -> TablePair:
        """Both sides cut to ``n`` rows (default: the smaller count), the first ones by ``row_key``; ties are equal rows."""
        if n is None:
            n = min(self.real.count(), self.fake.count())
        else:
            short = min(self.real.count(), self.fake.count())
            if n > short:
                raise ValueError(f"n_samples {n} exceeds the {short} rows of the smaller table")
        take = lambda df: df.orderBy(row_key(df.columns, self.seed)).limit(n)
        return replace(self, real=take(self.real), fake=take(self.fake))

    def imputed(self) -> TablePair:
        """Missing categories become ``[NAN]``, missing numbers their own side's mean. Text columns keep nulls."""
        cats = [c for c in self.categorical if c not in self.text]

        def fill(df: DataFrame) -> DataFrame:
            if self.numerical:
                # one row of means, joined without a shuffle
                means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"__mean_{c}") for c in self.numerical])
                df = df.join(F.broadcast(means))
            fixed = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__mean_{c}")) for c in self.numerical}
            fixed |= {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in cats}
            return df.withColumns(fixed).select(*self.real.columns)

        return replace(self, real=fill(self.real), fake=fill(self.fake))

    def roles(self) -> DataFrame:
        spark = self.real.sparkSession
        rows = [(c, "numerical" if c in self.numerical else "categorical", c in self.text) for c in self.real.columns]
        return spark.createDataFrame(rows, "column string, role string, is_text boolean")


def from_dict(spark, data: dict[str, float], key: str = "key", value: str = "value") -> DataFrame:
    """A mapping as a table of two columns."""
    return spark.createDataFrame([(str(k), float(v)) for k, v in data.items()], f"{key} string, {value} double")
