"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams (one to three characters of the lowered text) are
gathered by language, on the executors, from a bounded sample of labelled rows.
The log-probabilities, as fixed-point integers, are broadcast: ``N_BUCKETS`` x
``MAX_LANGUAGES`` x 4 bytes at most; more languages than that are several models,
each with a broadcast of its own, whose results are joined exactly. A batch of
texts becomes one sparse matrix of counts (compressed rows: buckets, counts, row
starts), and its product with the log-probabilities is the batch's scores.
Integers make a score the same in any order and batch size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Languages of one model, and so of one broadcast.
MAX_LANGUAGES = 64
#: Rows of each language that the fit takes, expected number; picked by a hash of the id and the text.
FIT_ROWS = 3000
FOLDS = 5
UNKNOWN = "und"
_ONE = 1 << 12  # fixed-point scale of a log-probability
#: Characters that one sparse matrix covers.
_CHUNK = 1 << 18
_MAX_ROWS = 1 << 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def pieces(texts: Iterable[str | None], size: int) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Lists of ``(text number, code points, n-gram starts)`` of ``size`` starts in all; a long text is cut, with an overlap."""
    longest, held, room = max(ORDERS), [], size
    for row, text in enumerate(texts):
        code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = 0
        while at < len(code):
            own = min(room, len(code) - at)
            held.append((row, code[at : at + own + longest - 1], own))
            at, room = at + own, room - own
            if not room or len(held) == _MAX_ROWS:
                yield held
                held, room = [], size
    if held:
        yield held


def sparse_counts(part: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, starts, buckets, counts)``: the compressed sparse rows of one list of pieces."""
    sizes = np.array([len(c) for _, c, _ in part])
    ends = np.cumsum(sizes)
    code = np.concatenate([c for _, c, _ in part]).astype(np.uint64)
    place = np.arange(len(code))
    left = np.repeat(ends, sizes) - place  # characters from here to the piece's end
    starts_here = place - np.repeat(ends - sizes, sizes) < np.repeat([own for _, _, own in part], sizes)
    row = np.repeat(np.arange(len(part), dtype=np.uint32) << np.uint32(16), sizes)
    keys = []
    h = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        own = len(code) - n + 1
        if own <= 0:
            break
        h = (h[:own] + code[n - 1 :] + np.uint64(n)) * _MIX[0]
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            whole = starts_here[:own] & (left[:own] >= n)
            keys.append((row[:own] | ((h * _MIX[1]) >> np.uint64(48)).astype(np.uint32))[whole])
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    begins = np.flatnonzero(np.append(True, key[1:] >> np.uint32(16) != key[:-1] >> np.uint32(16)))
    rows = np.array([r for r, _, _ in part])[key[begins] >> np.uint32(16)]
    return rows, begins, (key & np.uint32(0xFFFF)).astype(np.int64), counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """``languages`` in sorted order; ``weights[bucket, language]`` and ``prior[language]`` in fixed point."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def totals(self, texts: Sequence[str | None]) -> np.ndarray:
        """The log-probability of each text (row) and language, in fixed point."""
        out = np.tile(self.prior, (len(texts), 1))
        for part in pieces(texts, _CHUNK):
            rows, begins, buckets, counts = sparse_counts(part)
            # a text that is cut is in one list of pieces at most twice, so rows may repeat
            np.add.at(out, rows, np.add.reduceat(self.weights[buckets] * counts[:, None], begins, axis=0))
        return out

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str | None, int, float]]:
        """For each text the language, its log-probability, and the sum of all languages' probabilities over its own.

        No text or no letter gives None; of equal languages the first name wins.
        """
        total = self.totals(texts)
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        mass = np.exp((total - top[:, None]) / _ONE).sum(axis=1)
        return [(self.languages[b] if has_letter(t) else None, int(x), float(m)) for t, b, x, m in zip(texts, best, top, mass, strict=True)]


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, id_col: str = "doc_id") -> list[LanguageModel]:
    """Fit on rows with a language and a text: a model for each ``MAX_LANGUAGES`` languages, none without labelled rows.

    About ``fit_rows`` rows of each language are taken, all if it has fewer. A row a
    language reaches the driver.
    """
    labelled = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages, whole = sorted(sizes), float(sum(sizes.values()))

    def count(place: dict[str, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(place), N_BUCKETS), np.int64)
            for batch in batches:
                own = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
                for part in pieces((t.as_py() for t in batch.column(1)), _CHUNK):
                    texts, begins, buckets, counts = sparse_counts(part)
                    np.add.at(sums, (np.repeat(own[texts], np.diff(np.append(begins, len(buckets)))), buckets), counts)
            lang, bucket = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[lang, bucket])], ["place", "bucket", "n"])

        return run

    models = []
    for at in range(0, len(languages), MAX_LANGUAGES):
        own = languages[at : at + MAX_LANGUAGES]
        share = F.create_map(*[F.lit(x) for lang in own for x in (lang, float(min(1.0, fit_rows / sizes[lang])))])
        lucky = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < share[F.col("lang")]
        picked = labelled.where(F.col("lang").isin(own) & F.col("text").isNotNull() & lucky).select("lang", "text")
        # MAX_LANGUAGES * N_BUCKETS rows at most
        summed = picked.mapInArrow(count({x: i for i, x in enumerate(own)}), "place int, bucket int, n long").groupBy("place", "bucket").agg(F.sum("n").alias("n")).toArrow()
        weights = np.full((N_BUCKETS, len(own)), 0.5)
        weights[summed.column("bucket").to_numpy(), summed.column("place").to_numpy()] += summed.column("n").to_numpy()
        weights = np.log(weights / weights.sum(axis=0))
        prior = np.log(np.array([sizes[x] for x in own]) / whole)
        models.append(LanguageModel(own, np.rint(weights * _ONE).astype(np.int32), np.rint(prior * _ONE).astype(np.int64)))
    return models


def predictor(spark: SparkSession, model: LanguageModel):
    """A column function of the text alone: ``struct(lang, top, mass)``, see ``LanguageModel.predict``."""
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.prior))

    @F.pandas_udf("lang string, top long, mass double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = LanguageModel(*shared.value)
        for texts in parts:
            yield pd.DataFrame(own.predict(texts.tolist()), columns=["lang", "top", "mass"])

    return predict


def _predicted(docs: DataFrame, models: list[LanguageModel], text_col: str) -> DataFrame:
    """``(row, lang_pred, score)``: ``row`` holds all columns of ``docs``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if not models:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for i, m in enumerate(models):
        rows = rows.withColumn(f"p{i}", predictor(docs.sparkSession, m)(F.col("text")))
    names = [f"p{i}" for i in range(len(models))]
    best = F.col(names[0])
    for n in names[1:]:
        best = F.when(F.col(n)["top"] > best["top"], F.col(n)).otherwise(best)
    rows = rows.withColumn("best", best)
    mass = sum((F.col(n)["mass"] * F.exp((F.col(n)["top"] - F.col("best")["top"]) / _ONE) for n in names), F.lit(0.0))
    lang = F.col("best")["lang"]
    return rows.select("row", F.coalesce(lang, F.lit(UNKNOWN)).alias("lang_pred"), F.when(lang.isNull(), 0.0).otherwise(1.0 / mass).alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the ids that a fit must not see; a null id counts as seen by none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: a row a row of ``docs``, fitted on the rows that aren't held out.

    A null, empty or letterless text gives ``und`` with score 0, and so does every
    text if no row is labelled. Repeated rows get equal results; other columns
    aren't read; an empty table gives an empty result.
    """
    found = _predicted(docs.select(id_col, text_col), fit(docs.where(~held_out(id_col)), text_col, lang_col, fit_rows, id_col), text_col)
    return found.select(F.col(f"row.`{id_col}`").alias("doc_id"), held_out(f"row.`{id_col}`").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is found with a posterior of ``min_score`` or more.

    A null, empty or letterless text goes, and so does every row if none is
    labelled. Rows that repeat stay or go alike; columns may have any name; an
    empty table gives an empty result.
    """
    found = _predicted(docs, fit(docs.where(~held_out(id_col)), text_col, lang_col, id_col=id_col), text_col)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
