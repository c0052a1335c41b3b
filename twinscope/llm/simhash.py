"""SimHash near-dedup over a Gray-order hierarchical index.

1. Each text becomes a fingerprint of 64 bits or more (one Arrow pass, one text
   at a time).
2. Equal fingerprints are folded into one node by a partial aggregate, so a
   group of copies of any size costs one row a task.
3. Nodes meet by 16-bit blocks of their fingerprints: each goes to all its blocks;
   a block value that holds more than its share is cut into shards, and every
   pair of shards meets in a tile. With fewer differing bits than blocks two
   nodes always agree on a block, so nothing is lost.
4. Inside a tile the fingerprints are sorted by Gray rank. Runs of them become
   leaves and runs of leaves upper nodes; a node keeps the bits that all below
   it share and that its parent doesn't already hold. A search adds up the
   differing bits on the way down and leaves a whole group once they exceed
   the bound. Pairs are never emitted: a component grows from a few of its
   members, only what hasn't joined yet is searched, and a tile returns a
   spanning forest.
5. The forests' components come from label propagation with pointer jumping,
   over tables written in the shared folder.

Two settings: ``near_groups`` takes 64 bits of three-word shingles and links at
three bits, exactly. ``near_dedup`` takes ``WIDE_BITS`` bits of five-word shingles
and links at ``wide_bound(0.8)`` bits, the number expected of two texts with a
Jaccard similarity of 0.8 and half a standard deviation more; two texts link if
they also share one of the blocks, which texts of a similarity of 0.8 do nine
times in ten, of 0.9 nearly always.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, free_name, materialize, shuffle_partitions, whole_text

BITS = 64
BLOCK_BITS = 16
BLOCKS = BITS // BLOCK_BITS
MAX_DISTANCE = 3
SHINGLE_WORDS = 3
WIDE_BITS = 512
WIDE_WORDS = 5
SIMILARITY = 0.8
SEED = 42
_LEAF, _FAN = 16, 8
#: Tiles of at most so many fingerprints need no index; many of them are done at once.
_SMALL = 32
_CHUNK = 16_384
#: Fingerprints of a block value beyond this are cut into shards; a tile holds two of them.
MAX_TILE = 1 << 16
#: Pairs of a query and an entry that a search holds at a time.
_PAIRS = 1 << 20
_SEEDS = 256
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def wide_bound(similarity: float, bits: int = WIDE_BITS) -> int:
    """Differing bits of two texts whose shingle sets have that Jaccard similarity: the expected number and half a standard deviation."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + math.sqrt(bits * p * (1 - p)) / 2)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, bits: int = BITS) -> bytes:
    """The little-endian fingerprint of a UTF-8 text.

    ASCII capitals are lowered; words are runs of bytes other than 20, 09-0D.
    A bit is 1 if it is set in over half of the shingles' XXH64; each further 64
    bits come from another mix of the same hash. A text of fewer words than a
    shingle is one shingle; a text without words gives 0.
    """
    words = text.lower().split()
    if not words:
        return bytes(bits // 8)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(bits, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + shingle_words - 1]
        if n == 1:
            hashes = [digest(b" ".join(part), SEED)]
        elif shingle_words == 3:
            hashes = [digest(b"%b %b %b" % s, SEED) for s in zip(part, part[1:], part[2:], strict=False)]
        elif shingle_words == 5:
            hashes = [digest(b"%b %b %b %b %b" % s, SEED) for s in zip(part, part[1:], part[2:], part[3:], part[4:], strict=False)]
        else:
            hashes = [digest(b" ".join(part[i : i + shingle_words]), SEED) for i in range(len(part) - shingle_words + 1)]
        h = np.array(hashes, dtype="<u8")
        for word in range(bits // BITS):
            if word:
                h = (h ^ h >> np.uint64(30)) * _MIX[1] + _MIX[0]
                h = (h ^ h >> np.uint64(27)) * _MIX[2]
                h ^= h >> np.uint64(31)
            own = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[BITS * word : BITS * (word + 1)] += own.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def row_digest(id_col: str, text_col: str):
    """One value for a row's id and text together; a null id is told from all others, a null text is the empty one."""
    return F.sha2(F.encode(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("")), F.lit(" "), whole_text(f"`{text_col}`")), "UTF-8"), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, digest: bool = False, bits: int = BITS) -> DataFrame:
    """``(doc_id, fp)``: a row a document, ``fp`` the fingerprint as a signed integer if it has 64 bits, else as bytes; with ``digest`` also ``row_digest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", shingle_words, bits) for t in batch.column(1).cast(pa.binary())]
            fps = pa.array(np.frombuffer(b"".join(found), "<i8")) if bits == BITS else pa.array(found, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[row_digest(id_col, text_col).alias("row_digest")] * digest)
    return rows.mapInArrow(run, f"doc_id long, fp {'long' if bits == BITS else 'binary'}" + ", row_digest string" * digest)


def words_of(fps: pa.Array) -> np.ndarray:
    """A row a fingerprint, a column each 64 bits, the lowest first."""
    if pa.types.is_integer(fps.type):
        return fps.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    if not len(fps):
        return np.empty((0, 1), dtype=np.uint64)
    _, places, data = fps.buffers()
    places = np.frombuffer(places, "<i4")[fps.offset : fps.offset + len(fps) + 1]
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]].view("<u8").reshape(len(fps), -1)


def gray_order(fps: np.ndarray) -> np.ndarray:
    """The order of the fingerprints by their places in the reflected Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    # the parity of all higher words turns the bits of a lower one
    parity = np.bitwise_count(fps).astype(np.uint64) & np.uint64(1)
    above = np.cumsum(parity[:, ::-1], axis=1)[:, ::-1] - parity
    rank ^= np.where(above & np.uint64(1), ~np.uint64(0), np.uint64(0))
    return np.lexsort(rank.T)


class GrayIndex:
    """Hierarchical index over fingerprints (rows of 64-bit words), which must be in Gray order."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        ones, zeros = fps, ~fps
        levels = []
        step, size = _LEAF, len(fps)
        while True:
            at = np.arange(0, size, step)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            levels.append((ones | zeros, ones, np.append(at, size)))
            if len(at) <= _FAN:
                break
            step, size = _FAN, len(at)
        self.levels = []  # from the top: the bits of its own, their pattern, the first child of each node
        above = None
        for mask, pattern, first in reversed(levels):
            own = mask if above is None else mask & ~np.repeat(above[0], np.diff(above[1]), axis=0)
            self.levels.append((own, pattern & own, first))
            above = mask, first
        self.leaf_mask = levels[0][0]

    def near(self, queries: np.ndarray, most: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """Indices ``(query, entry)`` of all pairs that differ in at most ``most`` bits."""
        top = len(self.levels[0][0])
        who = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        apart = np.zeros(len(who), dtype=np.uint16)

        def differing(own, pattern, mask) -> np.ndarray:
            out = np.zeros(len(own), dtype=np.uint16)
            for w in range(queries.shape[1]):
                out += np.bitwise_count((queries[own, w] ^ pattern(w)) & mask(w))
            return out

        for own, pattern, first in self.levels:
            apart = apart + differing(who, lambda w: pattern[node, w], lambda w: own[node, w])  # noqa: B023
            stay = apart <= most
            who, node, apart = who[stay], node[stay], apart[stay]
            last = node
            below = first[node + 1] - first[node]
            start = np.repeat(first[node] - np.append(0, np.cumsum(below)[:-1]) if len(below) else below, below)
            node = start + np.arange(len(start))
            who, apart, last = np.repeat(who, below), np.repeat(apart, below), np.repeat(last, below)
        apart = apart + differing(who, lambda w: self.fps[node, w], lambda w: ~self.leaf_mask[last, w])
        hit = apart <= most
        return who[hit], node[hit]

    def pairs(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``near``, some queries at a time."""
        step = max(1, _PAIRS // max(1, len(self.fps)))
        for at in range(0, len(queries), step):
            who, hit = self.near(queries[at : at + step], most)
            yield who + at, hit


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least entry that each one is known to be joined with, once ``a`` and ``b`` are joined pairwise."""
    while len(a):
        x, y = label[a], label[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def small_forests(fps: np.ndarray, tile: np.ndarray, most: int = MAX_DISTANCE) -> np.ndarray:
    """``forest`` of many small tiles at once; the entries of a tile stand together, ``tile`` numbers them."""
    label = np.arange(len(fps))
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, len(fps)):
        a = np.flatnonzero(tile[k:] == tile[:-k])
        if not len(a):
            break
        a = a[np.bitwise_count(fps[a] ^ fps[a + k]).sum(axis=1, dtype=np.uint16) <= most]
        ends.append((a, a + k))
    return _join(label, *map(np.concatenate, zip(*ends, strict=True))) if ends else label


def forest(fps: np.ndarray, most: int = MAX_DISTANCE) -> np.ndarray:
    """For each of the fingerprints, in Gray order, the first one of its component within this array.

    Some entries that haven't joined a component are searched for among all such
    entries; what they reach is searched for in turn, among the entries that
    nothing reached yet, and among itself only where its components differ. So a
    dense group of n costs about n comparisons for each entry outside it.
    """
    n = len(fps)
    if n <= _SMALL:
        return small_forests(fps, np.zeros(n, dtype=np.int64), most)
    label = np.arange(n)
    alive = np.ones(n, dtype=bool)
    entries, index = np.arange(n), GrayIndex(fps)

    def search(who: np.ndarray) -> np.ndarray:
        """Join ``who`` with the living entries near it, and return these."""
        nonlocal label
        found = np.zeros(n, dtype=bool)
        for a, b in index.pairs(fps[who], most):
            a, b = who[a], entries[b]
            keep = alive[b]
            found[b[keep]] = True
            label = _join(label, a[keep], b[keep])
        return np.flatnonzero(found)

    while True:
        live = entries[alive[entries]]
        if not len(live):
            return label
        if 2 * len(live) < len(entries):
            entries, index = live, GrayIndex(fps[live])
        seeds = live[:_SEEDS]
        front = search(seeds)
        alive[seeds] = False
        front = front[alive[front]]
        while len(front):
            alive[front] = False
            roots, sizes = np.unique(label[front], return_counts=True)
            rest = front[label[front] != roots[sizes.argmax()]]
            if len(rest):
                for a, b in GrayIndex(fps[front]).pairs(fps[rest], most):
                    label = _join(label, rest[a], front[b])
            front = search(front)


def links(nodes: DataFrame, most: int = MAX_DISTANCE, bits: int = BITS) -> DataFrame:
    """``(a, b)``: edges between the fingerprints ``nodes (fp)``, enough of them to join all that share a block and link."""
    spark = nodes.sparkSession
    blocks, n, parts = bits // BLOCK_BITS, nodes.count(), shuffle_partitions(spark)
    share = min(MAX_TILE, max(256, -(-blocks * n // max(1, parts))))
    if bits == BITS:
        value = F.expr(f"cast(shiftrightunsigned(fp, block * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1} as int)")
    else:
        value = F.expr(f"cast(conv(hex(substring(fp, block * {BLOCK_BITS // 8} + 1, {BLOCK_BITS // 8})), 16, 10) as int)")
    routed = nodes.select("fp", F.explode(F.array(*[F.lit(i) for i in range(blocks)])).alias("block")).withColumn("value", value)
    # a row a full block value: blocks * 2**16 at most, whatever the input
    full = routed.groupBy("block", "value").count().where(F.col("count") > share)
    shards = full.select("block", "value", F.ceil(F.col("count") / F.lit(share)).cast("int").alias("shards"))
    routed = routed.join(F.broadcast(shards), ["block", "value"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    tiles = routed.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, shards - 1)")))
    tiles = tiles.select("block", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    tiles = tiles.repartition(parts, "block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(parts: list[pa.Array]) -> tuple[pa.Array, pa.Array]:
            ids = pa.concat_arrays(parts)
            fps = words_of(ids)
            order = gray_order(fps)
            first = forest(fps[order], most)
            at = np.nonzero(first != np.arange(len(first)))[0]
            return ids.take(pa.array(order[at])), ids.take(pa.array(order[first[at]]))

        held: list[pa.Array] = []
        held_key, out = None, []

        def close() -> None:
            if sum(map(len, held)) > 1:
                out.append(edges(held))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            ids = batch.column(4)
            starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)
            sizes = np.diff(np.append(starts, len(key)))
            if held_key is not None and (key[0] != held_key).any():
                close()
            held.append(ids.slice(0, sizes[0]))  # it may go on from the batch before
            if len(starts) > 1:
                close()
                inner = np.arange(1, len(starts) - 1)
                for i in inner[sizes[inner] > _SMALL]:
                    out.append(edges([ids.slice(starts[i], sizes[i])]))
                small = inner[(sizes[inner] > 1) & (sizes[inner] <= _SMALL)]
                if len(small):
                    tile = np.repeat(small, sizes[small])
                    rows = np.arange(len(tile)) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small]) + starts[tile]
                    first = small_forests(words_of(ids)[rows], tile, most)
                    at = np.flatnonzero(first != np.arange(len(first)))
                    out.append((ids.take(pa.array(rows[at])), ids.take(pa.array(rows[first[at]]))))
                held.append(ids.slice(starts[-1], sizes[-1]))
            held_key = key[-1]
            if sum(len(x) for x, _ in out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out, strict=True)], ["a", "b"])

    kind = nodes.schema["fp"].dataType.simpleString().replace("bigint", "long")
    return tiles.mapInArrow(run, f"a {kind}, b {kind}")


def _stars(edges: DataFrame) -> DataFrame:
    """Edges that join the same, fewer of them: what ``a`` leads to is tied to the least of it.

    A forest ties a member of a dense group to one root in each of its tiles, a few
    dozen at most; after this it is tied to one of them, and they to each other.
    """
    least = F.min("b").over(Window.partitionBy("a"))  # a row a tile that ``a`` is in
    tied = edges.withColumn("least", least)
    ends = F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b"))))
    return tied.select(ends.alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(v, label)``: for each end of ``edges (a, b)`` the smallest id that it reaches.

    Each round takes the least label of the neighbours, then the label of that
    label, until nothing changes. Each join reads two written tables, so that
    adaptive execution can split the partition of a node with many neighbours.
    """
    spark = edges.sparkSession
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b")))
    edges = _stars(_stars(edges))
    both = materialize(edges.select(ends.alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b")
        step = near.groupBy(F.col("a").alias("v")).agg(F.min("label").alias("up"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("was"))
        step = materialize(step, "labels")
        jump = step.select(F.col("v").alias("up"), F.col("up").alias("label"))
        after = materialize(step.join(jump, "up").select("v", "label", "was"), "labels")
        drop(spark, labels.shared_path)
        drop(spark, step.shared_path)
        labels = after
        if labels.where("label <> was").isEmpty():
            drop(spark, both.shared_path)
            out = labels.select("v", "label")
            out.shared_path = labels.shared_path
            return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, most: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)``: a row a row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``most``
    differing bits, the document itself included. A null text counts as a text
    without words, and all texts without words link (fingerprint 0). Rows that
    repeat an id get a row each. An empty table gives an empty result. Other
    columns aren't read. A null id takes part as an ordinary group member but
    never names a component unless the group has no other id.
    """
    if most >= BLOCKS:
        raise ValueError(f"routing on {BLOCKS} blocks finds all links of at most {BLOCKS - 1} bits, not of {most}")
    found, _ = _grouped(fingerprints(docs, id_col, text_col, shingle_words), most, BITS)
    return found.select("doc_id", "fp", "component_id")


def _grouped(prints: DataFrame, most: int, bits: int) -> tuple[DataFrame, list[str]]:
    """``prints`` with ``root``, one fingerprint for each component, and ``component_id``; and the working tables that it reads."""
    spark, read, used = prints.sparkSession, [], []

    def written(df: DataFrame, label: str, needed: bool = False) -> DataFrame:
        out = materialize(df, label)
        (read if needed else used).append(out.shared_path)
        return out

    prints = written(prints, "prints", True)
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = written(links(nodes.select("fp"), most, bits), "forest")
    if edges.isEmpty():
        table = nodes.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    else:
        joined = components(edges)
        used.append(joined.shared_path)
        table = nodes.join(joined, nodes.fp == joined.v, "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
        table = written(table, "roots")
        table = table.join(written(table.groupBy("root").agg(F.min("least").alias("component_id")), "components"), "root").select("fp", "root", "component_id")
    out = prints.join(written(table, "classes", True), "fp")
    for path in used:
        drop(spark, path)
    return out, read


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = WIDE_WORDS, similarity: float = SIMILARITY, bits: int = WIDE_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one row of each group, that of the smallest id.

    Texts of that similarity link as the module's text says. All texts without
    words, null ones too, are one group. A null id stays only in a group without
    other ids. Of rows that repeat the smallest id, or of a group without ids, the
    row whose id and text have the smallest digest stays; of rows that repeat both,
    any one. Columns may have any name; an empty table gives an empty result.
    """
    found, read = _grouped(fingerprints(docs, id_col, text_col, shingle_words, True, bits), wide_bound(similarity, bits), bits)
    found = materialize(found.select("root", "doc_id", "row_digest"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_digest"))["row_digest"]
    several = found.groupBy("root").agg(first.alias("stays"), F.count("*").alias("n")).where("n > 1")
    members = found.join(several.select("root", "stays"), "root")
    # what goes, and what repeats: both are small where few texts have a copy, and Spark picks the join by their size
    gone = materialize(members.where("row_digest <> stays").select("row_digest").distinct(), "gone")
    twice = materialize(members.where("row_digest = stays").groupBy("row_digest").count().where("count > 1").select("row_digest"), "twice")
    for path in [*read, found.shared_path]:
        drop(docs.sparkSession, path)
    key = free_name(docs, "row_digest")
    rows = docs.withColumn(key, row_digest(id_col, text_col))
    out = rows.join(gone.withColumnRenamed("row_digest", key), key, "left_anti")
    if not twice.isEmpty():
        twice = twice.withColumnRenamed("row_digest", key)
        once = rows.join(twice, key, "left_semi").dropDuplicates([key])
        out = out.join(twice, key, "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
