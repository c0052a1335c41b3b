"""What the operators share: working tables in the shared folder (from the library), settings, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import drop, materialize, new_folder, shared_root

__all__ = ["drop", "free_name", "materialize", "new_folder", "shared_root", "shuffle_partitions", "whole_text"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores put before it until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def whole_text(column: str = "text"):
    """The text column with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
