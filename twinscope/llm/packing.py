"""Packing by power-of-two decomposition.

A document's ids and a closing id 0 are cut into pieces whose lengths are powers
of two, the largest first: as many of the full length as fit, then the binary
digits of the rest. Every piece is a sequence of its own, so no sequence crosses
documents and none has padding. Sequences of one length form a bucket. A
sequence's number holds its bucket in the highest bits, then the task, then its
place among the task's pieces of that length: a bucket is one range of numbers,
and no row has to reach the driver to number them.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LATER, SPACE, Kept, byte_alphabet, shared_spec
from .shared import materialize

MAX_LENGTH = 1024
STORE = 1 << 19
#: Bits of a sequence number for the task and for the place; above them is the bucket, log2 of the length.
TASK_BITS, PLACE_BITS = 24, 34
#: Bytes of text that are looked at together; a longer text is cut, if it can be.
STEP = 1 << 22
#: Kinds of characters: of the sentinels, white space, letters, numbers, others.
_NONE, _BLANK, _LETTER, _NUMBER, _OTHER = range(5)
#: Bytes that no UTF-8 has: the end of a text, and a special token's place.
_END, _SPECIAL = 0xFF, 0xFE
#: Before ASCII white space that doesn't follow white space.
_CUT = re.compile(rb"(?<![\t-\r ])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80)(?=[\t-\r ])")


def cuts(size: int, most: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``size`` ids; ``most`` is a power of two."""
    out = [(at, most) for at in range(0, size - most + 1, most)]
    at = len(out) * most
    for bit in range(most.bit_length() - 2, -1, -1):
        if (size - at) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


@functools.cache
def kinds() -> np.ndarray:
    """The kind of each code point, as the library's tables have it."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = np.delete(np.arange(0x110000, dtype="<u4"), slice(0xD800, 0xE000)).tobytes().decode("utf-32-le")
    for kind, pattern in ((_LETTER, f"[\\p{{L}}--[{LATER}]]+"), (_NUMBER, f"[\\p{{N}}--[{LATER}]]+"), (_BLANK, f"[{SPACE}]+")):
        for m in regex.finditer(pattern, every, regex.V1):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte is of."""
    table = kinds()
    first = np.append(table[:0x80], np.full(0x80, _NONE, np.uint8))
    out = first[data]
    high = np.flatnonzero(data >= 0xC0)
    lead = data[high]
    for size, low, most in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = high[(lead >= low) & (lead < most)]
        if not len(at):
            continue
        point = (data[at] & (0x7F >> size)).astype(np.int32)
        for k in range(1, size):
            point = point << 6 | (data[at + k] & 0x3F)
        kind = table[point]
        for k in range(size):
            out[at + k] = kind
    return out


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where the words of the byte-level pre-tokenizer's pattern begin; a sentinel is one, and the last byte must be one.

    A word is a run of one kind. Of white space before another character the last
    one is apart, and belongs to the run behind it if it is a space. An apostrophe
    that begins a word takes the letters of a contraction.
    """
    kind = kinds_of(data)
    start = np.ones(len(data), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NONE)
    black = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] > _BLANK)) + 1
    last = black - 1
    start[black] = data[last] != 0x20
    wide = np.flatnonzero(data[last] >= 0x80)
    last[wide] -= np.where(data[last[wide] - 1] >= 0xC0, 1, 2)  # white space has at most three bytes
    start[last] = True
    at = np.flatnonzero(data == 0x27)
    at = at[start[at]]
    one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    pair = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
    size = np.where((one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64), 2, np.where(pair, 3, 0))
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    start[at + size] |= kind[at + size] == _LETTER
    return np.flatnonzero(start)


class LibraryIds:
    """Ids as little-endian 32-bit integers, from the tokenizers library.

    Many texts are cut into words together, by the kinds of their bytes, and Arrow
    makes the words distinct. The ids of words not met before are those of the
    library's model; a bounded store keeps them. The strings of special tokens are
    found first. A tokenizer with another pre-tokenizer, a normalizer or special
    tokens that look around encodes each text as a whole.
    """

    def __init__(self, spec: bytes, store: int = STORE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        own = json.loads(spec)
        before, added = own.get("pre_tokenizer") or {}, own.get("added_tokens", [])
        self.plain = (
            not own.get("normalizer")
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space", True)
            and before.get("use_regex", True)
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added)
        )
        self.bytes = dict(enumerate(byte_alphabet()))
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.special = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.words = Kept(self._of_words, store)

    def _of_words(self, words: list[bytes]) -> Iterator[bytes]:
        for w in words:
            if w[0] >= _SPECIAL:
                yield bytes(4)
            else:
                yield array("I", [t.id for t in self.model.tokenize(w.decode("latin-1").translate(self.bytes))]).tobytes()

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text and a closing id 0."""
        if not texts:
            return []
        joined = b"".join([x for t in texts for x in (t, b"\xff")])
        specials: list[bytes] = []
        if any(s in joined for s in self.added):
            specials = self.special.findall(joined)
            joined = self.special.sub(b"\xfe", joined)
        data = np.frombuffer(joined, np.uint8)
        starts = word_starts(data)
        offsets = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        ids, where = list(self.words.all(words.dictionary.to_pylist())), words.indices
        if specials:
            numbers = where.to_numpy().copy()
            numbers[data[starts] == _SPECIAL] = len(ids) + np.arange(len(specials), dtype=np.int32)
            ids += [self.added[s].to_bytes(4, "little") for s in specials]
            where = pa.array(numbers)
        found = pa.array(ids, pa.binary()).take(where)
        ends = np.frombuffer(found.buffers()[1], np.int32)[np.flatnonzero(data[starts] == _END) + 1].tolist()
        out = found.buffers()[2].to_pybytes()
        return [out[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _long(self, text: bytes, step: int) -> bytes:
        """A text cut before white space that follows another character: no word crosses that place, and none looks back."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + step)
            end = cut.start() if cut else len(text)
            out.append(self._together([text[at:end]])[0][:-4])
            at = end
        return b"".join([*out, bytes(4)])

    def closed(self, texts: Iterable[bytes], step: int = STEP) -> Iterator[bytes]:
        """The ids of each text, in UTF-8, and a closing id 0."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            if not self.plain:
                yield array("I", [*self.library.encode(text.decode(), add_special_tokens=False).ids, 0]).tobytes()
            elif len(text) > step:
                yield from self._together(held)
                held, size = [], 0
                yield self._long(text, step)
            else:
                held.append(text)
                size += len(text)
                if size > step or len(held) >= 1 << 16:
                    yield from self._together(held)
                    held, size = [], 0
        yield from self._together(held)

    def encode(self, text: str) -> bytes:
        return next(self.closed([text.encode()]))[:-4]


@functools.lru_cache(maxsize=2)
def library_of(spec: bytes, store: int) -> LibraryIds:
    """A worker's tokenizer, which its later tasks use again with the ids it has kept."""
    return LibraryIds(spec, store)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LENGTH, store: int = STORE) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: a row a piece.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers,
    ``doc_tokens`` counts the document's ids with the closing one, ``sequence_id`` is
    unique and falls into one range for each length, and ``offset`` is 0. ``store`` bounds how many words a generation of a worker's store
    of ids holds: a smaller one costs time, not results. A null or empty text is one piece with the closing id. Rows that repeat
    are packed each; other columns aren't read; an empty table gives an empty
    result.
    """
    if not 0 < most <= 1 << 30 or most & (most - 1):
        raise ValueError("the length of a sequence must be a power of two, 2**30 at most")
    spec = shared_spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library_of(spec.value, store)
        task = TaskContext.get().partitionId()
        if task >> TASK_BITS:
            raise ValueError(f"more than {1 << TASK_BITS} tasks")
        begun: dict[int, int] = {}
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id"])
            rows.clear()
            held = 0
            return batch

        for batch in batches:
            texts = batch.column(1)
            texts.validate(full=True)  # the bytes are looked at as UTF-8
            for i, ids in zip(batch.column(0).to_pylist(), known.closed(t.as_py() or b"" for t in texts.cast(pa.binary())), strict=True):
                size = len(ids) // 4
                for start, length in cuts(size, most):
                    place = begun.get(length, 0)
                    begun[length] = place + 1
                    bucket = length.bit_length() - 1
                    rows.append((i, start, length, ids[4 * start : 4 * (start + length)], size, (bucket << TASK_BITS | task) << PLACE_BITS | place))
                held += len(ids)
                if held > 4 << 20:
                    yield flush()
        if rows:
            yield flush()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # written once, so that a number that was handed out stays the same
    pieces = materialize(plain.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long"), "pieces")
    return pieces.withColumn("offset", F.lit(0).cast("long"))
