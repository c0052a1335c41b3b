"""Distances from each row of a table to the nearest row of another, over all rows.

Equal rows are one point. A few points on the other side are held by every task;
more are cut into cells by a tree of cuts, fitted on a bounded sample of them. A
row first looks in its own cell, then in each cell whose bounding box is nearer
than what it found: no other cell can hold a nearer row, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import materialize

#: Most points of the other side that every task holds.
MOST_HELD = 20_000
#: Points a cell, most cells, and sampled points a cell to cut them by.
CELL_POINTS, MOST_CELLS, SAMPLED = 4096, 4096, 64
#: About as many rows meet a cell in one group.
GROUP_ROWS = 1 << 16


def nearest(df: DataFrame, other: DataFrame, columns: Sequence[str], held: int = MOST_HELD, cell_points: int = CELL_POINTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(n, d)``, a row a distinct point of ``df``: how many rows have it, and the Euclidean distance to the nearest row of ``other``; a written table.

    Rows with a missing value are left out on both sides; without any in ``other`` there is no row.
    """
    xs = [f"x{i}" for i in range(len(columns))]
    points = lambda t: t.select(*[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(columns, xs, strict=True)]).na.drop()
    mine = points(df).groupBy(*xs).agg(F.count("*").alias("n"))
    others = materialize(points(other).distinct(), "points")
    size = others.count()
    if not size:
        found = mine.where(F.lit(False)).withColumn("d2", F.lit(0.0))
    elif size <= held:
        found = _beside_all(mine, _matrix(others.toArrow(), xs), xs)
    else:
        found = _by_cells(mine, others, xs, size, cell_points, group_rows)
    return materialize(found.select("n", F.sqrt("d2").alias("d")), "nearest")


def _matrix(rows: pa.Table | pa.RecordBatch, xs: Sequence[str]) -> np.ndarray:
    return np.column_stack([rows.column(x).to_numpy() for x in xs])


def _least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The squared distance of each row of ``x`` to the nearest of ``y``; differences rather than products, so that equal rows are 0 apart to the last digit."""
    out, step = np.empty(len(x)), max(1, (1 << 20) // len(y))
    for at in range(0, len(x), step):
        out[at : at + step] = sum((x[at : at + step, k, None] - y[None, :, k]) ** 2 for k in range(x.shape[1])).min(axis=1)
    return out


def _beside_all(mine: DataFrame, y: np.ndarray, xs: Sequence[str]) -> DataFrame:
    spark = mine.sparkSession
    shared = spark.sparkContext.broadcast(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("n"), pa.array(_least(_matrix(b, xs), shared.value))], ["n", "d2"])

    return mine.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "n long, d2 double")


class Cuts:
    """A tree of cuts: a node has its column (-1: a leaf), the value from which rows go to the second child, its children and its cell."""

    def __init__(self, sample: np.ndarray, cells: int):
        self._nodes: list[list] = []
        self.cells = self.depth = 0
        self._grow(sample, cells, 0)
        column, cut, low, high, cell = zip(*self._nodes, strict=True)
        self.column, self.cut, self.children, self.cell = np.array(column), np.array(cut), np.array([low, high]), np.array(cell)

    def _grow(self, rows: np.ndarray, cells: int, depth: int) -> int:
        own = len(self._nodes)
        node = [-1, 0.0, 0, 0, -1]
        self._nodes.append(node)
        self.depth = max(self.depth, depth)
        wide = np.ptp(rows, axis=0)
        at = int(wide.argmax())
        if cells < 2 or not wide[at] > 0:
            node[4] = self.cells
            self.cells += 1
            return own
        x = rows[:, at]
        cut = np.median(x)
        if not (x < cut).any():  # many rows have the least value
            cut = x[x > x.min()].min()
        node[:2] = at, cut
        node[2] = self._grow(rows[x < cut], cells // 2, depth + 1)
        node[3] = self._grow(rows[x >= cut], cells // 2, depth + 1)
        return own

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            column = self.column[node]
            side = (x[rows, np.maximum(column, 0)] >= self.cut[node]).astype(int)
            node = np.where(column < 0, node, self.children[side, node])
        return self.cell[node]


def _by_cells(mine: DataFrame, others: DataFrame, xs: Sequence[str], size: int, cell_points: int, group_rows: int) -> DataFrame:
    spark = mine.sparkSession
    cells = min(MOST_CELLS, 1 << max(1, (-(-size // cell_points) - 1).bit_length()))
    # SAMPLED * MOST_CELLS points at most, give or take: only where the cuts lie depends on them
    share = min(1.0, SAMPLED * cells / size)
    sample = _matrix(others.where(F.pmod(F.xxhash64(*xs), F.lit(1 << 20)) < share * (1 << 20)).toArrow(), xs)
    cuts = Cuts(sample if len(sample) else np.zeros((1, len(xs))), cells)
    shared = spark.sparkContext.broadcast(cuts)
    points = ", ".join(f"{x} double" for x in xs)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("cell", pa.array(shared.value.home(_matrix(b, xs)), pa.int32()))

    others = materialize(others.mapInArrow(home, f"{points}, cell int"), "cells")
    found = others.groupBy("cell").agg(*[f(x).alias(f"{name}_{x}") for name, f in (("lo", F.min), ("hi", F.max)) for x in xs]).toArrow()  # a row a cell
    lo, hi = np.full((cuts.cells, len(xs)), np.inf), np.full((cuts.cells, len(xs)), np.inf)  # a cell without points is out of reach
    at = found.column("cell").to_numpy()
    for k, x in enumerate(xs):
        lo[at, k], hi[at, k] = found.column(f"lo_{x}").to_numpy(), found.column(f"hi_{x}").to_numpy()
    boxes = spark.sparkContext.broadcast((lo, hi))
    # a row whose own cell has no point is as far from it as can be
    first = materialize(_meet(materialize(mine.mapInArrow(home, f"{points}, n long, cell int"), "homes"), others, xs, group_rows), "first")

    def nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = boxes.value
        step = max(1, (1 << 20) // len(lo))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                x = _matrix(b, xs)
                # as distances are computed, so that a box is never farther than a row in it
                gap = sum(np.maximum(np.maximum(lo[None, :, k] - x[:, k, None], x[:, k, None] - hi[None, :, k]), 0.0) ** 2 for k in range(len(xs)))
                near = gap < b.column("d2").to_numpy()[:, None]
                near[np.arange(len(x)), b.column("cell").to_numpy()] = False
                row, cell = np.nonzero(near)
                own = b.select([*xs, "n"]).take(pa.array(row))
                yield own.append_column("cell", pa.array(cell, pa.int32()))

    again = materialize(first.mapInArrow(nearer, f"{points}, n long, cell int"), "nearer")
    both = first.unionByName(_meet(again, others, xs, group_rows))
    return both.groupBy(*xs).agg(F.max("n").alias("n"), F.min("d2").alias("d2"))


def _meet(mine: DataFrame, others: DataFrame, xs: Sequence[str], group_rows: int) -> DataFrame:
    """``mine (x..., n, cell)`` with ``d2``, the least squared distance to a point of the cell; many rows of one cell are several groups."""
    spark = mine.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = [(r["cell"], -(-r["count"] // group_rows)) for r in mine.groupBy("cell").count().collect()]  # a row a cell
    groups = F.broadcast(spark.createDataFrame(counts, "cell int, groups int"))
    left = mine.join(groups, "cell").withColumn("group", F.pmod(F.xxhash64(*xs), F.col("groups")).cast("int")).drop("groups")
    right = others.join(groups, "cell").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    schema = ", ".join([*[f"{x} double" for x in xs], "n long", "cell int", "d2 double"])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        d2 = _least(_matrix(a, xs), _matrix(b, xs)) if a.num_rows and b.num_rows else np.full(a.num_rows, np.inf)
        return a.select([*xs, "n", "cell"]).append_column("d2", pa.array(d2, pa.float64()))

    # as many tasks as the session has partitions: a row is little to read and much to compare
    key = ["cell", "group"]
    return left.repartition(parts, *key).groupBy(*key).cogroup(right.repartition(parts, *key).groupBy(*key)).applyInArrow(run, schema)
