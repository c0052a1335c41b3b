"""BPE encoding and decoding as streaming transducers.

``sufficient_lookahead`` bounds, from the merge list alone, how many symbols to
the right of a place can still change whether a merge is applied there. A word
longer than the window is then encoded left to right: the window's tokens that
end that far before its edge are stable and leave, and the window moves on. What
is held is one window, whatever the word's length. Decoding is a state machine
too: ids in, text out as soon as its bytes are whole.

Merges at a boundary: let ``f(r)`` be how far beyond its right end a place can
be and still decide on rule ``r = (u, v)``. It is the most of ``f`` of the rule that
makes ``v``; of ``f`` of the rule that makes ``u``, less the length of ``v``; and, for
each earlier rule ``q = (v, x)`` that would take ``v`` away, of ``|x| + f(q)``. All of
these come before ``r`` in the list, so one pass in order gives all bounds.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Words, and for chunks half as many, that a generation of a worker's store holds with their ids.
CACHE_WORDS = 1 << 17
#: Characters of a text that are looked at in one go; a chunk longer than this is fed in fragments.
STEP = 1 << 16
#: Only chunks of at most so many characters are kept.
_KEPT_CHARS = 64
#: A list of symbols longer than this is merged through a heap.
_SHORT = 48


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


# Capitals that Python's tables don't know yet, with their small letters.
LATER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITALS = regex.compile("[" + "".join(map(chr, LATER_CAPITALS)) + "]")


def lower_each(text: str) -> str:
    """Lower case character by character: unlike ``str.lower`` a final sigma gets no form of its own."""
    if text.isascii():
        return text.lower()
    if _CAPITALS.search(text):
        text = text.translate(LATER_CAPITALS)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class BpeModel:
    """A byte-level BPE from a tokenizer's JSON: vocabulary, ranked merges, word pattern, word-end mark."""

    def __init__(self, spec: bytes):
        own = json.loads(spec)
        model = own["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in own.get("added_tokens", [])}
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.tokens = [""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        kinds = json.dumps(own.get("normalizer") or {})
        self.nfc, self.lower = '"NFC"' in kinds, '"Lowercase"' in kinds
        steps = own["pre_tokenizer"].get("pretokenizers") or [own["pre_tokenizer"]]
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), GPT_WORDS)
        spaced = pattern.replace("[^\\s", "[^" + SPACE).replace("\\s", "[" + SPACE + "]").replace("\\S", "[^" + SPACE + "]")
        self.words = regex.compile(spaced)
        # the same with letters and numbers that the library doesn't know yet taken out, for texts that hold any
        older = spaced.replace("\\p{L}", "[\\p{L}--[" + LATER + "]]").replace("\\p{N}", "[\\p{N}--[" + LATER + "]]")
        self.older_words = regex.compile(older, regex.V1)
        self.later = regex.compile("[" + LATER + "]")
        # the runs of one kind that a word can be; where numbers make no runs a word of a number is that one alone
        self.spaced = "\\s" in pattern.replace("[^\\s", "")
        letter, number = ("[\\p{%s}--[%s]]" % (k, LATER) for k in "LN")
        self.runs = [regex.compile(x, regex.V1) for x in (f"{letter}++", f"[[^{SPACE}]--{letter}--{number}]++", *[f"{number}++"] * ("\\p{N}+" in pattern))]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.byte_decoder = (own.get("decoder") or {}).get("type") == "ByteLevel"
        self.alphabet = byte_alphabet()
        self.longest = max(map(len, self.vocab))
        self.lookahead = sufficient_lookahead(merges, self.end)
        self.window = self.longest + 4 * self.lookahead + 2

    def symbols(self, word: str) -> list[str]:
        """A symbol a byte, without the word-end mark."""
        return list(map(self.alphabet.__getitem__, word.encode("utf-8", "surrogatepass")))

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges applied: always the pair of the lowest rank, the leftmost of equal ones."""
        if len(symbols) > _SHORT:
            return self._merged_long(symbols)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """``merged`` with the candidate pairs in a heap; a symbol that a merge took is None."""
        rank, size = self.rank, len(symbols)
        own: list[str | None] = list(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if own[i] is None or j == size or rank.get((own[i], own[j])) != r:
                continue
            own[i], own[j] = own[i] + own[j], None
            after[i] = j = after[j]
            if j < size:
                before[j] = i
                if (r := rank.get((own[i], own[j]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((own[h], own[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in own if x is not None]

    def word_ids(self, word: str) -> bytes:
        """The ids of a whole word as little-endian 32-bit integers."""
        if len(word) > _KEPT_CHARS:
            own = Transducer(self)
            tokens = [*own.feed(word), *own.finish()]
        else:  # shorter than a window: all of it is held anyway
            tokens = self.symbols(word)
            tokens[-1] += self.end
            tokens = self.merged(tokens)
        return b"".join([self.packed[t] for t in tokens if t in self.packed])

    def split(self, text: str) -> list[str]:
        """The words of a normal text."""
        if not text.isascii() and self.later.search(text):
            return self.older_words.findall(text)
        return self.words.findall(text)

    def segments(self, text: str) -> Iterator[tuple[str | None, int, int]]:
        """The text cut at the strings of special tokens: ``(the token or None, start, end)``."""
        at = 0
        if self.special is not None and any(s in text for s in self.added):
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield None, at, m.start()
                yield m[0], m.start(), m.end()
                at = m.end()
        if at < len(text):
            yield None, at, len(text)

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return lower_each(text) if self.lower else text


#: White space as Unicode has it, for a character class.
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Letters and numbers that the Unicode standard has gained since version 16, which the library's tables follow.
LATER = "".join(
    f"\\U{int(a, 16):08x}-\\U{int(b or a, 16):08x}"
    for a, _, b in (
        x.partition("-")
        for x in (
            "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 "
            "10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 "
            "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 "
            "1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
            "2cea2-2cead 323b0-33479 3d000-3fc3f"
        ).split()
    )
)
#: The word pattern that the byte-level pre-tokenizer has built in (fixed value).
GPT_WORDS = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"


def sufficient_lookahead(merges: list[tuple[str, str]], end: str = "") -> int:
    """Symbols beyond a token's end that can decide on it; see the module's text."""
    size = lambda s: len(s) - (len(end) if end and s.endswith(end) and len(s) > len(end) else 0)
    made: dict[str, int] = {}  # f of the rule that makes a symbol
    taken: dict[str, int] = {}  # the most of |x| + f(q) over the rules (v, x) so far
    most = 0
    for u, v in merges:
        far = max(0, made.get(v, 0), made.get(u, 0) - size(v), taken.get(v, 0))
        made[u + v] = max(made.get(u + v, 0), far)
        taken[u] = max(taken.get(u, 0), size(v) + far)
        most = max(most, far, size(v) + far)
    return most


class Long(NamedTuple):
    """Where a chunk lies that is longer than a step."""

    start: int
    end: int


_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_EDGE = re.compile(f"[^{SPACE}][{SPACE}]")
_BLACK = re.compile(f"[^{SPACE}]")


def chunk_lists(text: str, start: int = 0, end: int | None = None, step: int = STEP) -> Iterator[list[str] | Long]:
    """The text cut before each white space that follows another character; lists of about ``step`` characters in all."""
    end = len(text) if end is None else end
    while start < end:
        stop = min(end, start + step)
        found = _CHUNK.findall(text, start, stop)
        if stop < end:
            tail = found.pop()  # it may go on
            stop -= len(tail)
            if not found:
                edge = _EDGE.search(text, start, end)
                stop = edge.start() + 1 if edge else end
                yield Long(start, stop)
        if found:
            yield found
        start = stop


@functools.cache
def _joining() -> frozenset[str]:
    """Characters that composition can join to what stands before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    vowels, tails = range(0x1161, 0x1176), range(0x11A8, 0x11C3)  # of Hangul
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | frozenset(map(chr, (*vowels, *tails)))


def _begins(c: str) -> bool:
    """Whether normalising the text before ``c`` and from ``c`` on apart changes nothing."""
    return c < "\u0300" or (not unicodedata.combining(c) and c not in _joining())


class Transducer:
    """Parts of one word in, tokens out once nothing to their right can change them."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.held: list[str] = []

    def _stable(self, spare: int) -> Iterator[str]:
        model, at = self.model, 0
        while len(self.held) - at > model.window + spare:
            end = 0
            for token in model.merged(self.held[at : at + model.window]):
                if end + len(token) + model.lookahead + 1 > model.window:
                    break
                end += len(token)  # a character a symbol: none inside the window carries the word-end mark
                yield token
            at += end
        del self.held[:at]

    def feed(self, part: str) -> Iterator[str]:
        self.held += self.model.symbols(part)
        # the last symbol waits, for it may turn out to be the word's end
        yield from self._stable(1)

    def finish(self) -> Iterator[str]:
        if self.held:
            self.held[-1] += self.model.end
            yield from self._stable(0)
            yield from self.model.merged(self.held)
            self.held = []


class Kept:
    """Strings with their ids, of bounded size: a full generation becomes the old one, from which what is met again moves on."""

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], most: int = CACHE_WORDS):
        self.make, self.most = make, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def all(self, strings: list[str]) -> Iterable[bytes]:
        """The ids of all ``strings``; those not known are made together."""
        out = list(map(self.young.get, strings))
        if None not in out:
            return out
        new = {s for s, ids in zip(strings, out) if ids is None}  # noqa: B905
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, {}
            new = set(strings)
        first = list(new.difference(self.old))
        if len(first) < len(new):
            self.young.update((s, self.old[s]) for s in new.difference(first))
        self.young.update(zip(first, self.make(first), strict=True))
        out = list(map(self.young.__getitem__, strings))
        for s in first:
            if len(s) > _KEPT_CHARS:
                del self.young[s]
        return out


class Encoder:
    def __init__(self, model: BpeModel, step: int = STEP):
        self.model, self.step = model, step
        self.words = Kept(lambda words: map(model.word_ids, words))
        self.chunks = Kept(self._of_chunks, CACHE_WORDS // 2)

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        """ASCII chunks that begin with white space and end without are split in one go: the pattern cuts between them as it does in a text."""
        model, blank = self.model, " \t\n\x0b\x0c\r"
        joined = [c for c in chunks if c.isascii() and c[0] in blank and c[-1] not in blank]
        words = model.split(model.normal("".join(joined)))
        sizes = [len(c if model.spaced else c.lstrip(blank)) for c in joined]
        rest = list(set(chunks).difference(joined))
        for c in rest:
            own = model.split(model.normal(c))
            sizes.append(sum(map(len, own)))
            words += own
        found = zip(words, self.words.all(words), strict=True)
        out: dict[str, bytes] = {}
        for c, left in zip(joined + rest, sizes, strict=True):
            parts = []
            while left:
                w, ids = next(found)
                left -= len(w)
                parts.append(ids)
            out[c] = b"".join(parts)
        return list(map(out.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        return b"".join(self.stream(text))

    def stream(self, text: str) -> Iterator[bytes]:
        """The same ids, part by part."""
        model = self.model
        for special, start, end in model.segments(text):
            if special is not None:
                yield _packed([model.added[special]])
                continue
            for chunks in chunk_lists(text, start, end, self.step):
                if isinstance(chunks, Long):
                    yield from self._long(text, chunks)
                    continue
                yield b"".join(self.chunks.all(chunks))

    def _long(self, text: str, where: Long) -> Iterator[bytes]:
        """A chunk in fragments: a word that reaches a fragment's end stays open for the next one."""
        model, vocab = self.model, self.model.vocab
        ids = lambda tokens: _packed([vocab[t] for t in tokens if t in vocab])
        start, end = where
        black = _BLACK.search(text, start, end)
        if (gap := black.start() if black else end) - start > 1:
            blank = gap - 1 if black else gap  # the last white space belongs to the word after it, if there is one
            if model.spaced:
                own = Transducer(model)
                for at in range(start, blank, self.step):
                    yield ids(own.feed(text[at : min(at + self.step, blank)]))
                yield ids(own.finish())
            start = blank
        rest, open_run, own = "", None, Transducer(model)
        while start < end:
            stop = min(end, start + self.step)
            while stop < end and not _begins(text[stop]):
                stop += 1
            part = rest + model.normal(text[start:stop])
            start, rest = stop, ""
            if open_run is not None:
                m = open_run.match(part)
                if m:
                    yield ids(own.feed(m[0]))
                    part = part[m.end() :]
                if part:
                    yield ids(own.finish())
                    open_run = None
            if not part:
                continue
            words = [(m.start(), m[0]) for m in model.older_words.finditer(part)]
            if start < end:
                # a contraction may begin in the last three characters
                while words and words[-1][0] >= len(part) - 3:
                    rest = part[words.pop()[0] :]
                if not rest and words and words[-1][0] + len(words[-1][1]) == len(part):
                    last = words.pop()[1]
                    open_run = next(r for r in model.runs if r.match(last[-1]))
                    own = Transducer(model)
                    opened = ids(own.feed(last))
                else:
                    opened = b""
            else:
                opened = b""
            yield b"".join(self.words.all([w for _, w in words]))
            yield opened
        yield ids(own.finish())


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<i4").tobytes()


class Decoder:
    """Ids in, text out. The state is one flag and the bytes of an unfinished character."""

    def __init__(self, model: BpeModel):
        self.tokens, self.bytes = model.tokens, model.byte_decoder
        back = {c: b for b, c in enumerate(model.alphabet)}
        self.raw = [bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode() for t in self.tokens] if self.bytes else []
        self.reset()

    def reset(self) -> None:
        self.begun = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.bytes:
            return self.utf8.decode(b"".join(map(self.raw.__getitem__, ids)))
        text = " ".join(map(self.tokens.__getitem__, ids))  # tokens are text already: one space between them
        if not self.begun:
            self.begun = bool(text)
            return text
        return " " + text if text else ""

    def finish(self) -> str:
        rest = self.utf8.decode(b"", True)
        self.reset()
        return rest

    def decode(self, ids: np.ndarray | list[int], step: int = 1 << 16) -> str:
        self.reset()
        ids = np.asarray(ids, dtype=np.int64)
        parts = [self.feed(ids[at : at + step].tolist()) for at in range(0, len(ids), step)]
        return "".join(parts) + self.finish()


@functools.lru_cache(maxsize=2)
def encoder_of(spec: bytes) -> Encoder:
    """A worker's encoder, which its later tasks use again with what it has learnt."""
    return Encoder(BpeModel(spec))


def shared_spec(spark: SparkSession, path: str):
    """The tokenizer's file, read on the driver and broadcast: its size is fixed and doesn't grow with the data."""
    with open(path, "rb") as f:
        spec = f.read()
    return spark.sparkContext.broadcast(spec)


def default_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def with_column(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of ``docs`` with a last column ``name``, in place of any that has the name."""
    return T.StructType([f for f in docs.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def _append(batch: pa.RecordBatch, at: int, keep: list[int], name: str, new: pa.Array) -> pa.RecordBatch:
    part = batch.slice(at, len(new))
    return pa.RecordBatch.from_arrays([part.column(i) for i in keep] + [new], [part.schema.names[i] for i in keep] + [name])


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a column of ids (array of int) as the tokenizer's own library gives them without added special tokens.

    Strings of special tokens inside a text are those tokens. A null or empty
    text has no ids. Rows may repeat; an existing column ``ids_col`` is replaced;
    all other columns pass through; an empty table gives an empty result.
    """
    spec = shared_spec(docs.sparkSession, path)
    names = docs.columns
    source = names.index(text_col)
    keep = [i for i, n in enumerate(names) if n.lower() != ids_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for batch in batches:
            at, parts, held = 0, [], 0
            for i, text in enumerate(batch.column(source)):
                parts.append(encoder.encode(text.as_py() or ""))
                held += len(parts[-1])
                if held > 4 << 20 or i == batch.num_rows - 1:
                    offsets = np.append(0, np.cumsum([len(p) // 4 for p in parts])).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
                    yield _append(batch, at, keep, ids_col, ids)
                    at, parts, held = i + 1, [], 0

    return docs.mapInArrow(run, with_column(docs, ids_col, T.ArrayType(T.IntegerType(), False)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with a column of the text of their ids, special tokens included.

    Null or no ids give the empty text. Bytes that make no character become
    U+FFFD. Rows may repeat; an existing column ``text_col`` is replaced; all other
    columns pass through; an empty table gives an empty result.
    """
    spec = shared_spec(rows.sparkSession, path)
    names = rows.columns
    source = names.index(ids_col)
    keep = [i for i, n in enumerate(names) if n.lower() != text_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(encoder_of(spec.value).model)
        for batch in batches:
            at, parts, held = 0, [], 0
            for i, ids in enumerate(batch.column(source)):
                parts.append(decoder.decode(ids.values.to_numpy() if ids.is_valid and len(ids) else []))
                held += len(parts[-1])
                if held > 4 << 20 or i == batch.num_rows - 1:
                    yield _append(batch, at, keep, text_col, pa.array(parts, pa.string()))
                    at, parts, held = i + 1, [], 0

    return rows.mapInArrow(run, with_column(rows, text_col, T.StringType()))
