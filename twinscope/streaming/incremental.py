"""Additive measures over streams of real and fake rows.

Counts, moments and histograms add up, so they run as Structured Streaming
aggregates. ``(column, side)`` states are small; a watermark bounds windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import work


def _long(tagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return tagged.withColumn("e", F.explode(pairs)).where("e.value is not null and not isnan(e.value)")


def running_moments(tagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, side, n, mean, std)`` so far, of a stream with a column ``side``."""
    v = F.col("e.value")
    return _long(tagged, columns).groupBy(F.col("e.column").alias("column"), "side").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def windowed_moments(tagged: DataFrame, columns: Sequence[str], time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same by tumbling window of ``time``; rows later than ``late`` are left out."""
    v = F.col("e.value")
    return _long(tagged.withWatermark(time, late), columns).groupBy(F.window(time, window).alias("w"), F.col("e.column").alias("column"), "side").agg(F.count(v).alias("n"), F.avg(v).alias("mean"))


def running_histogram(tagged: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """``(bin, real, fake)`` so far over fixed right-closed bins; bin 0 and the last one take what lies outside."""
    at = F.array(*[F.lit(float(e)) for e in edges])
    bin_: Column = F.size(F.filter(at, lambda e: e < F.col(column).cast("double")))
    rows = tagged.where(F.col(column).isNotNull()).select(bin_.alias("bin"), "side")
    return rows.groupBy("bin").agg(F.sum("side").alias("real"), F.sum(1 - F.col("side")).alias("fake"))


def collected(running: DataFrame) -> DataFrame:
    """The last state of a running aggregate whose sources have an end, as a written table: all there is is read, batch by batch."""
    spark = running.sparkSession
    top = work.new_folder(spark, "stream")
    last: list[str] = []

    def keep(state: DataFrame, batch: int) -> None:
        path = f"{top}/state-{batch}"
        state.write.mode("overwrite").parquet(path)  # a batch that runs again writes its own folder again
        last[:] = [path]

    running.writeStream.outputMode("complete").option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(running.schema).parquet(last[0]) if last else spark.createDataFrame([], running.schema)
