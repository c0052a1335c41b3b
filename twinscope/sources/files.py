"""Readers and writers: aligned pairs from CSV or Parquet, results to any Spark format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def align_loaded(real: DataFrame, fake: DataFrame, drop_columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Bring a loaded pair to one schema.

    If all columns of ``fake`` are in ``real``, ``real`` is cut to them in their
    order. Else ``drop_columns`` go on both sides, counts must agree, and the
    columns of ``fake`` are renamed by position. Then ``fake`` is cast to the
    types of ``real``.
    """
    if set(fake.columns) <= set(real.columns):
        real = real.select(*fake.columns)
    else:
        if drop_columns:
            missing = [c for c in drop_columns if c not in real.columns and c not in fake.columns]
            if missing:
                raise ValueError(f"no columns to drop named {missing}")
            real, fake = real.drop(*drop_columns), fake.drop(*drop_columns)
        if len(real.columns) != len(fake.columns):
            raise ValueError(f"{len(real.columns)} and {len(fake.columns)} columns can't be matched by position")
        fake = fake.toDF(*real.columns)
    kinds = dict(zip(real.columns, [f.dataType for f in real.schema.fields], strict=True))
    return real, fake.select(*[F.col(c).cast(kinds[c]).alias(c) for c in real.columns])


def load_csv_pair(spark: SparkSession, real: str, fake: str, real_sep: str = ",", fake_sep: str = ",", drop_columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    read = lambda path, sep: spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    return align_loaded(read(real, real_sep), read(fake, fake_sep), drop_columns)


def load_parquet_pair(spark: SparkSession, real: str, fake: str, drop_columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    return align_loaded(spark.read.parquet(real), spark.read.parquet(fake), drop_columns)


def write_report(parts: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "overwrite") -> list[str]:
    """Each result as a table of its own below ``folder``."""
    paths = []
    for name, df in parts.items():
        df.write.format(fmt).mode(mode).save(f"{folder}/{name}")
        paths.append(f"{folder}/{name}")
    return paths
