"""Exact dedup through an extendible-hash index on shared files.

The directory starts with one bucket and splits every bucket that holds more
keys than its capacity, doubling when the bucket is as deep as the directory.
It is grown from a count of distinct keys by leading hash bits, so only counts
reach the driver. Buckets in the order of their keys are dealt to owners, so that
each owner holds one range of keys. Each map task folds its own copies, the
folded entries go to the owners, and each owner walks its keys in order: entries
with one key form a chain, and an entry joins a copy on it only if all bytes are
equal. The owners write the index (a row a distinct text) to the shared folder,
and the rows find their bucket through the directory and their group in it.
``exact_dedup`` lets the folded entries carry the row that stays, so that a text
crosses the network once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, shuffle_partitions, whole_text

#: No directory is larger than this; capacity rises with the input instead.
MAX_DEPTH = 20
BUCKETS_PER_OWNER = 64
#: Bytes of text that a map task folds before it passes entries on.
FOLD_BYTES = 8 << 20
#: Rows that a task looks at in one go.
STEP_ROWS = 500


class Directory:
    """Extendible-hash directory over the leading bits of an unsigned 64-bit key."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.global_depth = 0
        self.slots = [0]  # the bucket of each slot
        self.local_depth = [0]
        self.prefix = [0]  # of each bucket, as many bits as it is deep
        self.sizes = [0]  # keys of each bucket when the directory was grown

    @classmethod
    def grown(cls, counts: dict[int, int], depth: int, capacity: int) -> Directory:
        """The directory after the keys of ``counts`` (by their leading ``depth`` bits) are in."""
        own = cls(capacity)
        keys = sorted(counts)
        todo = [(0, keys)]
        while todo:
            bucket, inside = todo.pop()
            level = own.local_depth[bucket]
            own.sizes[bucket] = sum(counts[k] for k in inside)
            if level >= depth or own.sizes[bucket] <= capacity:
                continue
            new = own.split(bucket)
            own.sizes.append(0)
            bit = depth - 1 - level
            todo += [(bucket, [k for k in inside if not k >> bit & 1]), (new, [k for k in inside if k >> bit & 1])]
        return own

    def split(self, bucket: int) -> int:
        """Give the upper half of the bucket's key range to a new bucket."""
        if self.local_depth[bucket] == self.global_depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.global_depth += 1
        self.local_depth[bucket] += 1
        new, upper = len(self.local_depth), 2 * self.prefix[bucket] + 1
        self.local_depth.append(self.local_depth[bucket])
        self.prefix[bucket] = upper - 1
        self.prefix.append(upper)
        width = 1 << self.global_depth - self.local_depth[bucket]
        self.slots[upper * width : (upper + 1) * width] = [new] * width
        return new

    def bucket(self, key: int) -> int:
        return self.slots[key >> (64 - self.global_depth)] if self.global_depth else 0

    def slot_owners(self, owners: int) -> np.ndarray:
        """The owner of each slot: ranges of keys of about equal numbers, a bucket never split."""
        slots = np.array(self.slots)
        first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
        sizes = np.array([self.sizes[b] for b in slots[first]])
        before = np.cumsum(sizes) - sizes
        each = np.minimum(owners - 1, before * owners // max(1, sizes.sum()))
        return np.repeat(each, np.diff(np.append(first, len(slots)))).astype(np.int32)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(slot, bucket)``: 2**MAX_DEPTH rows at most."""
        return spark.createDataFrame(pa.table({"slot": pa.array(range(len(self.slots)), pa.int64()), "bucket": pa.array(self.slots, pa.int32())}))

    def slot(self, key) -> Column:
        """The slot of a signed 64-bit key."""
        return F.shiftrightunsigned(key, 64 - self.global_depth).cast("long") if self.global_depth else F.lit(0).cast("long")


def directory_for(keys: DataFrame, owners: int) -> Directory:
    """``keys`` has one column ``key`` (signed 64-bit). Only counts by prefix are collected, ``2**MAX_DEPTH`` at most."""
    distinct = keys.groupBy("key").agg(F.lit(1).alias("one"))
    depth = min(MAX_DEPTH, max(4, (owners * BUCKETS_PER_OWNER).bit_length()))
    rows = distinct.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("prefix")).count().collect()
    counts = {r["prefix"]: r["count"] for r in rows}
    total = sum(counts.values())
    return Directory.grown(counts, depth, max(16, 4 * total // (owners * BUCKETS_PER_OWNER)))


def _later(a: tuple[int | None, int], b: tuple[int | None, int]) -> bool:
    """Whether row ``a`` (id, tie) goes before ``b``: the larger id, any id before none, then the smaller tie."""
    if a[0] != b[0]:
        return b[0] is None or (a[0] is not None and a[0] > b[0])
    return a[1] < b[1]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what is made of one, text by text, is held beside it."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(at, STEP_ROWS)


def _fold(owners: np.ndarray, depth: int):
    """Entries ``(owner, *columns)`` from rows ``(key, text, id, tie, n, ...)``: the row that stays for each distinct text, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def fold(table: pa.Table) -> pa.Table:
            chains: dict[int, list[list]] = {}
            keys, ids, ties, counts = (table.column(c).to_pylist() for c in ("key", "id", "tie", "n"))
            texts = table.column("text").cast(pa.large_binary())
            for at, (key, text) in enumerate(zip(keys, texts, strict=True)):
                text = text.as_py()
                chain = chains.setdefault(key, [])
                for entry in chain:
                    if entry[0] == text:
                        entry[2] += counts[at]
                        if _later((ids[at], ties[at]), (ids[entry[1]], ties[entry[1]])):
                            entry[1] = at
                        break
                else:
                    chain.append([text, at, counts[at]])
            stay = [(at, n) for chain in chains.values() for _, at, n in chain]
            out = table.take(pa.array([at for at, _ in stay], pa.int64()))
            return out.set_column(out.schema.get_field_index("n"), "n", pa.array([n for _, n in stay], pa.int64()))

        def entries(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = table.column("key").to_numpy().view(np.uint64)
            own = owners[(key >> np.uint64(64 - depth)).astype(np.int64)] if depth else np.zeros(len(key), np.int32)
            yield from table.add_column(0, "owner", pa.array(own, pa.int32())).to_batches(max_chunksize=STEP_ROWS)

        for batch in _sliced(batches):
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.nbytes > FOLD_BYTES:
                held = fold(held)
                if held.nbytes > FOLD_BYTES // 2:
                    yield from entries(held)
                    held = None
        if held is not None and held.num_rows:
            yield from entries(fold(held))

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a distinct text, ``place`` in its key's chain before the columns of the entries, which come sorted by key."""
    chain: list[list] = []  # text, id and tie, copies, the entry's own row
    key = None
    for batch in _sliced(batches):
        done: list[tuple[int, int, pa.RecordBatch]] = []
        keys, ids, ties, counts = (batch.column(c).to_pylist() for c in ("key", "id", "tie", "n"))
        for at, (k, text) in enumerate(zip(keys, batch.column("text").cast(pa.large_binary()), strict=True)):
            text = text.as_py()
            if k != key:
                done += [(place, n, row) for place, (_, _, n, row) in enumerate(chain)]
                key, chain = k, []
            own = (ids[at], ties[at])
            for entry in chain:
                if entry[0] == text:
                    entry[2] += counts[at]
                    if _later(own, entry[1]):
                        entry[1], entry[3] = own, (batch, at)
                    break
            else:
                chain.append([text, own, counts[at], (batch, at)])
        # the open chain's rows leave this batch, so that it can go
        for entry in chain:
            if entry[3][0] is batch and batch.num_rows > 1:
                entry[3] = (batch.take(pa.array([entry[3][1]])), 0)
        if done:
            yield _gathered(done)
    if chain:
        yield _gathered([(place, n, row) for place, (_, _, n, row) in enumerate(chain)])


def _gathered(done: list[tuple]) -> pa.RecordBatch:
    parts: list[tuple[pa.RecordBatch, list[int]]] = []
    for _, _, (batch, at) in done:
        if not parts or parts[-1][0] is not batch:
            parts.append((batch, []))
        parts[-1][1].append(at)
    table = pa.Table.from_batches([b.take(pa.array(at, pa.int64())) for b, at in parts])
    table = table.set_column(table.schema.get_field_index("n"), "n", pa.array([n for _, n, _ in done], pa.int64()))
    return table.add_column(0, "place", pa.array([p for p, _, _ in done], pa.int32())).combine_chunks().to_batches()[0]


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _own(batches):
        digests = [hashlib.sha256(t.as_py()).hexdigest() for t in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("place"), pa.array(digests, pa.string()), batch.column("id"), batch.column("n")], ["key", "place", "text_sha256", "keep_id", "group_size"])


def _owned(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> tuple[DataFrame, Directory]:
    """The folded entries of ``docs`` with their columns ``more``, at their owners, in the order of their keys."""
    owners = shuffle_partitions(docs.sparkSession)
    text = whole_text(f"`{text_col}`")
    found = directory_for(docs.select(F.xxhash64(text).alias("key")), owners)
    rows = docs.select(F.xxhash64(text).alias("key"), text.alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"), *(more or [F.lit(0).cast("long").alias("tie")]), F.lit(1).cast("long").alias("n"))
    schema = T.StructType([T.StructField("owner", T.IntegerType()), *rows.schema.fields])
    folded = rows.mapInArrow(_fold(found.slot_owners(owners), found.global_depth), schema)
    return folded.repartitionById(owners, F.col("owner")).drop("owner").sortWithinPartitions("key"), found


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Directory]:
    """The index, a row a distinct text, ``(bucket, key, place, text_sha256, keep_id, group_size)``, in the shared folder, and its directory."""
    owned, found = _owned(docs, id_col, text_col)
    entries = owned.mapInArrow(_indexed, "key long, place int, text_sha256 string, keep_id long, group_size long")
    return _placed(materialize(entries, "exact-index"), found), found


def _placed(rows: DataFrame, found: Directory) -> DataFrame:
    """``rows`` with the ``bucket`` of their key, looked up in the directory, which is broadcast."""
    return rows.withColumn("slot", found.slot(F.col("key"))).join(F.broadcast(found.table(rows.sparkSession)), "slot").drop("slot")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``: a row a row of ``docs``.

    Texts are equal when all their bytes are; null counts as the empty text and
    nothing is normalised. ``keep_id`` is the largest id of the group. Rows that
    repeat both id and text are all ``kept`` if that id is (``exact_dedup`` keeps
    one of them). A null id stays only in a group without other ids. An empty
    table gives an empty result; columns other than id and text aren't read.
    """
    index, found = build_index(docs, id_col, text_col)
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"))
    joined = _placed(rows, found).join(index.select("bucket", "key", "text_sha256", "keep_id", "group_size"), ["bucket", "key", "text_sha256"])
    return joined.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each distinct text.

    That is the row of the largest id; a null id stays only in a group without
    other ids. Of rows that repeat text and id the one whose other columns have the
    smallest hash stays. A null text equals the empty one, and the row that stays
    has its own. Columns may have any name; an empty table gives an empty result.
    """
    plain = docs.schema[text_col].dataType == T.StringType()
    others = [c for c in docs.columns if c != text_col or not plain]
    row = F.struct(F.col(f"`{text_col}`").isNull().alias("no_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rest = [F.col(f"`{c}`") for c in others if c != text_col]
    owned, _ = _owned(docs, id_col, text_col, F.xxhash64(F.to_json(F.struct(*rest)) if rest else F.lit("")).alias("tie"), row.alias("row"))
    out = owned.mapInArrow(_own, T.StructType([T.StructField("place", T.IntegerType()), *owned.schema.fields]))
    back = {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
    if plain:
        back[text_col] = F.when(~F.col("row.no_text"), F.col("text"))
    return out.select(*[back[c].alias(c) for c in docs.columns])
