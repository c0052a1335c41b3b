"""Line dedup over overlapping windows of three lines.

Every run of three consecutive lines is hashed to 128 bits. A partial aggregate
finds the windows that occur more than once and the place of the first one (the
smallest document id, null last, then the smallest position). All later
occurrences are removed: the positions that they cover are merged, and the other
lines stay. A document is an id together with a 128-bit hash of its text, so rows
that share an id, or have none, but not the text are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, whole_text

WINDOW = 3
#: The document: its id and a hash of its text in two halves.
KEY = ["doc_id", "text_hi", "text_lo"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hi"), F.xxhash64(F.lit(1), text).alias("text_lo"), text.alias("text"))


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.select(KEY)
            first = 0
            sizes: list[int] = []
            digests: list[bytes] = []
            for text in batch.column("text").cast(pa.binary()):
                lines = text.as_py().split(b"\n")
                own = [xxhash.xxh3_128_digest(b"\n".join(lines[k : k + size])) for k in range(len(lines) - size + 1)]
                sizes.append(len(own))
                digests += own
                if len(digests) > 200_000:
                    yield _batch(docs.slice(first, len(sizes)), sizes, digests)
                    first, sizes, digests = first + len(sizes), [], []
            if digests:
                yield _batch(docs.slice(first, len(sizes)), sizes, digests)

    return run


def _batch(docs: pa.RecordBatch, sizes: list[int], digests: list[bytes]) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    count = np.array(sizes)
    at = np.arange(len(halves)) - np.repeat(np.cumsum(count) - count, count)
    own = docs.take(pa.array(np.repeat(np.arange(len(sizes)), count)))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(at, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], [*KEY, "at", "hi", "lo"])


def without(text: str, starts: list[int] | None, size: int = WINDOW) -> tuple[str, int, int]:
    """The text without the lines that the windows at ``starts`` cover, its number of lines, and how many went."""
    lines = text.split("\n")
    if not starts:
        return text, len(lines), 0
    gone = np.zeros(len(lines) + 1, dtype=np.int64)
    at = np.unique(starts)
    gone[at] += 1
    gone[np.minimum(at + size, len(lines))] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    return "\n".join(x for x, s in zip(lines, stay, strict=True) if s), len(lines), int((~stay).sum())


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``(doc_id, text_hi, text_lo, starts)``: the line numbers, from 0, at which a window starts that occurred before; documents with any."""
    found = _keyed(docs, id_col, text_col).mapInArrow(_windows(size), "doc_id long, text_hi long, text_lo long, at int, hi long, lo long")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), *KEY, "at")
    repeated = found.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    repeated = materialize(repeated.select("hi", "lo", *[F.col(f"first.{c}").alias(f"first_{c}") for c in (*KEY, "at")]), "windows")
    same = " and ".join(f"{c} <=> first_{c}" for c in (*KEY, "at"))
    later = found.join(repeated, ["hi", "lo"]).where(f"not ({same})").select(*KEY, "at")
    # the positions of one document: its own lines bound them
    return later.groupBy(*KEY).agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed)``: a row a row of ``docs``, in which only the first of equal windows stays.

    Null counts as the empty text, which is one empty line. A text with fewer
    lines than a window stays as it is. Lines are split at ``\\n`` alone and must
    be equal byte for byte. Rows that repeat an id and a text are one document:
    they get the same result. Rows of one id with other texts are documents of
    their own, in the order of their texts' hashes; rows without an id come after
    all others. An empty table gives an empty result; other columns aren't read.
    """
    rows = _keyed(docs, id_col, text_col)
    starts = later_windows(docs, id_col, text_col, size).select(*[F.col(c).alias(f"own_{c}") for c in KEY], "starts")
    joined = rows.join(starts, F.expr(" and ".join(f"{c} <=> own_{c}" for c in KEY)), "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [without(t.as_py(), s.as_py(), size) for t, s in zip(batch.column(1), batch.column(2), strict=True)]
            text, lines, gone = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_lines", "n_removed"])

    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long")
