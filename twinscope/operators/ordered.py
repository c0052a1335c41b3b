"""Tables in the order of their keys, cut into ranges, with what a range's rows say of each other.

The ranges come from Spark's range partitioning: as many as the session has
shuffle partitions, fewer where adaptive execution joins small ones, so that a
range's size stays the same as a table grows. A function of one whole range adds
its columns, and the table is written once; what earlier and later ranges add is
a small table, a row a key and range, that callers compute from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..work import materialize


class Segments:
    """The rows of one range, in order, as numpy columns; a segment has one key, and without keys all rows are one."""

    def __init__(self, table: pa.Table, keys: Sequence[str]):
        self.table = table
        n = table.num_rows
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        for k in keys:
            code = table.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, n))

    def __getitem__(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def spread(self, each: np.ndarray) -> np.ndarray:
        """One value a segment, on all its rows."""
        return np.repeat(each, self.sizes)

    def running(self, x: np.ndarray) -> np.ndarray:
        """Sums up to each row, from its segment's start."""
        total = np.cumsum(x)
        return total - self.spread(total[self.starts] - x[self.starts])

    def following(self, x: np.ndarray) -> np.ndarray:
        """The next row's value, NaN at a segment's end."""
        out = np.append(x[1:], np.nan)
        out[self.starts + self.sizes - 1] = np.nan
        return out

    def preceding(self, x: np.ndarray) -> np.ndarray:
        """The row before's value, NaN at a segment's start."""
        out = np.append(np.nan, x[:-1])
        out[self.starts] = np.nan
        return out

    def next_known(self, x: np.ndarray) -> np.ndarray:
        """The first value that isn't NaN from each row on, NaN if the segment has none left."""
        at = np.where(np.isnan(x), len(x), np.arange(len(x)))
        at = np.minimum.accumulate(at[::-1])[::-1]
        ends = self.spread(self.starts + self.sizes)
        return np.where(at < ends, x[np.minimum(at, len(x) - 1)], np.nan)


def ordered(df: DataFrame, keys: Sequence[str], by: Sequence[str], add: Callable[[Segments], dict[str, np.ndarray]], more: str, label: str) -> DataFrame:
    """``df`` in ranges of ``keys`` and ``by``, with ``part``, the range's number, and the columns ``more`` that ``add`` makes; a written table."""
    fields = [*df.schema.fields, T.StructField("part", T.IntegerType()), *T._parse_datatype_string(more).fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if not sum(b.num_rows for b in own):
            return
        table = pa.Table.from_batches(own)
        made = add(Segments(table, keys))
        part = pa.array(np.full(table.num_rows, TaskContext.get().partitionId(), np.int32))
        columns = [*table.columns, part, *[pa.array(x, from_pandas=True) for x in made.values()]]
        yield from pa.table(columns, names).to_batches(max_chunksize=50_000)

    cut = df.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by)
    return materialize(cut.mapInArrow(run, T.StructType(fields)), label)
