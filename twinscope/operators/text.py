"""Similarity of two text corpora."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import CONSISTENCY, LEXICAL, SEMANTIC, TEXT_OVERALL, TFIDF
from ..functions.text import tokens, without_stop_words
from ..pair import TablePair, row_key
from .dist import _gap, ecdf, ks_p_value


def _texts(pair: TablePair, column: str) -> DataFrame:
    return pair.tagged([column]).select("side", F.col(column).cast("string").alias("text")).where("text is not null")


def token_counts(pair: TablePair, column: str) -> DataFrame:
    """``(token, real, fake)``: how often each token occurs on either side."""
    each = _texts(pair, column).select("side", F.explode(tokens(F.col("text"))).alias("token"))
    return each.groupBy("token").agg(F.sum("side").cast("long").alias("real"), F.sum(1 - F.col("side")).cast("long").alias("fake"))


def length_similarity(pair: TablePair, column: str, unit: str = "word") -> DataFrame:
    """One row ``(ks_statistic, p_value, significant, similarity, mean_real, mean_fake, std_real, std_fake)`` of lengths over 0.

    No lengths on a side give statistic 1 and p-value 0; ``significant`` is a p-value below 0.05.
    """
    if unit not in ("word", "char"):
        raise ValueError("unit must be word or char")
    size = F.size(tokens(F.col("text"))) if unit == "word" else F.length("text")
    lengths = _texts(pair, column).select("side", size.cast("double").alias("value"), F.lit("x").alias("column")).where("value > 0")
    steps = ecdf(lengths).agg(F.max(_gap()).alias("ks"), F.max("nr").alias("nr"), F.max("nf").alias("nf"))
    r, f = F.when(F.col("side") == 1, F.col("value")), F.when(F.col("side") == 0, F.col("value"))
    moments = lengths.agg(*[F.coalesce(x, F.lit(0.0)).alias(n) for n, x in (("mean_real", F.avg(r)), ("mean_fake", F.avg(f)), ("std_real", F.stddev_samp(r)), ("std_fake", F.stddev_samp(f)))])
    none = (F.coalesce("nr", F.lit(0)) == 0) | (F.coalesce("nf", F.lit(0)) == 0)
    stat = F.when(none, F.lit(1.0)).otherwise(F.col("ks"))
    p = F.when(none, F.lit(0.0)).otherwise(ks_p_value(F.col("ks"), F.col("nr"), F.col("nf")))
    return steps.select(stat.alias("ks_statistic"), p.alias("p_value"), (p < 0.05).alias("significant"), (1 - stat).alias("similarity")).join(F.broadcast(moments))


def vocabulary_overlap(pair: TablePair, column: str, min_frequency: int = 1) -> DataFrame:
    """One row ``(real_size, fake_size, shared, jaccard, diversity_ratio)``; the ratio is null if only the real side is empty."""
    counts = token_counts(pair, column)
    has = lambda c: (F.col(c) >= min_frequency) & (F.col(c) > 0)
    n = lambda x: F.count(F.when(x, 1))
    out = counts.agg(n(has("real")).alias("real_size"), n(has("fake")).alias("fake_size"), n(has("real") & has("fake")).alias("shared"))
    union = F.col("real_size") + F.col("fake_size") - F.col("shared")
    empty = F.col("real_size") + F.col("fake_size") == 0
    jaccard = F.when(empty, F.lit(1.0)).otherwise(F.try_divide(F.col("shared").cast("double"), union.cast("double")))
    ratio = F.when(empty, F.lit(1.0)).otherwise(F.try_divide(F.col("fake_size").cast("double"), F.col("real_size").cast("double")))
    return out.withColumns({"jaccard": jaccard, "diversity_ratio": ratio})


def tfidf_similarity(pair: TablePair, column: str, max_features: int = 10000, ngram_range: tuple[int, int] = (1, 2), min_df: int = 2, max_df: float = 0.95, id_columns: Sequence[str] = ()) -> DataFrame:
    """One row ``(cosine, distance, vocabulary_size, norm_real, norm_fake)`` of the sides' mean TF-IDF vectors.

    Terms are words of two characters or more without stop words, and pairs of
    them; those in fewer than ``min_df`` documents or in more than a share of
    ``max_df`` are left out; of the rest the ``max_features`` most frequent stay.
    Weights are counts times ln((1+N)/(1+df))+1, rows have length 1.
    """
    words = without_stop_words(F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 2))
    texts = _texts(pair, column).select("side", words.alias("words"))
    n_docs = texts.agg(F.coalesce(F.sum("side"), F.lit(0)).cast("double").alias("n1"), F.coalesce(F.sum(1 - F.col("side")), F.lit(0)).cast("double").alias("n0"))
    # a document's terms are counted in its row; only terms with their counts are shuffled
    terms = texts.mapInArrow(_term_counts(ngram_range), "term string, df long, total long").groupBy("term").agg(F.sum("df").cast("double").alias("df"), F.sum("total").cast("double").alias("total"))
    total = F.col("n1") + F.col("n0")
    kept = terms.join(F.broadcast(n_docs)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * total))
    kept = kept.orderBy(F.desc("total"), "term").limit(max_features).select("term", (F.ln((1 + total) / (1 + F.col("df"))) + 1).alias("idf")).collect()  # max_features rows
    vocabulary = {r["term"]: (i, r["idf"]) for i, r in enumerate(kept)}
    shared = pair.real.sparkSession.sparkContext.broadcast(vocabulary)
    sums = texts.mapInArrow(_unit_sums(ngram_range, shared), "term int, s1 double, s0 double").groupBy("term").agg(F.sum("s1").alias("s1"), F.sum("s0").alias("s0"))
    mean = sums.join(F.broadcast(n_docs)).select(*[F.coalesce(F.try_divide(F.col(f"s{s}"), F.col(f"n{s}")), F.lit(0.0)).alias(x) for s, x in ((1, "r"), (0, "f"))])
    norm = lambda c: F.sqrt(F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0)))
    cosine = F.coalesce(F.try_divide(F.sum(F.col("r") * F.col("f")), norm("r") * norm("f")), F.lit(0.0))
    return mean.agg(cosine.alias("cosine"), (1 - cosine).alias("distance"), F.count("*").alias("vocabulary_size"), norm("r").alias("norm_real"), norm("f").alias("norm_fake"))


def _terms(words: list[str], ngram_range: tuple[int, int]) -> Counter:
    out: Counter = Counter()
    for n in range(ngram_range[0], ngram_range[1] + 1):
        out.update(words if n == 1 else map(" ".join, zip(*[words[i:] for i in range(n)], strict=False)))
    return out


def _term_counts(ngram_range: tuple[int, int], most: int = 200_000):
    """Rows ``(term, df, total)`` of the documents of a task, summed as far as ``most`` terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(df, pa.string()), pa.array(df.values(), pa.int64()), pa.array([total[t] for t in df], pa.int64())], ["term", "df", "total"])
            df.clear()
            total.clear()
            return out

        for batch in batches:
            for words in batch.column(1):
                own = _terms(words.as_py() or [], ngram_range)
                df.update(own.keys())
                total.update(own)
                if len(df) > most:
                    yield flush()
        if df:
            yield flush()

    return run


def _unit_sums(ngram_range: tuple[int, int], shared):
    """Rows ``(term, s1, s0)``: a task's sums of the documents' unit vectors, by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        sums = np.zeros((2, len(vocabulary)))
        seen = np.zeros(len(vocabulary), dtype=bool)
        for batch in batches:
            for side, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = [(*vocabulary[t], n) for t, n in _terms(words.as_py() or [], ngram_range).items() if t in vocabulary]
                if own:
                    at, idf, n = map(np.array, zip(*own, strict=True))
                    w = n * idf
                    sums[side, at] += w / np.sqrt((w * w).sum())
                    seen[at] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[1, at]), pa.array(sums[0, at])], ["term", "s1", "s0"])

    return run


def embedding_similarity(pair: TablePair, column: str, max_samples: int | None = None) -> DataFrame:
    """One row ``(cosine, n_real, n_fake)`` of the sides' mean vectors; ``column`` holds arrays of numbers.

    A text column becomes one by any column function or ``pandas_udf`` first.
    """
    rows = pair.tagged([column]).where(F.col(column).isNotNull())
    if max_samples:
        key = row_key([column], pair.seed)
        side = lambda s: rows.where(F.col("side") == s).orderBy(key).limit(max_samples)
        rows = side(1).unionByName(side(0))
    parts = rows.select("side", F.posexplode(column).alias("at", "x"))
    mean = parts.groupBy("at").agg(*[F.avg(F.when(F.col("side") == s, F.col("x").cast("double"))).alias(n) for s, n in ((1, "r"), (0, "f"))])
    n = rows.agg(F.sum("side").cast("long").alias("n_real"), F.sum(1 - F.col("side")).cast("long").alias("n_fake"))
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    out = mean.agg(F.coalesce(F.try_divide(F.sum(F.col("r") * F.col("f")), norm("r") * norm("f")), F.lit(0.0)).alias("cosine"))
    return out.join(F.broadcast(n))


def tfidf_evaluation(pair: TablePair, column: str, **how) -> DataFrame:
    """The row of ``tfidf_similarity`` with its rating."""
    return tfidf_similarity(pair, column, **how).withColumn("rating", TFIDF.column(F.col("cosine")))


def semantic_evaluation(pair: TablePair, column: str, max_samples: int | None = None) -> DataFrame:
    """The row of ``embedding_similarity`` with its rating."""
    return embedding_similarity(pair, column, max_samples).withColumn("rating", SEMANTIC.column(F.col("cosine")))


def encoded(pair: TablePair, column: str, encoder, name: str = "embedding") -> TablePair:
    """The pair with a vector column that ``encoder``, a function of a column, makes from ``column``."""
    from dataclasses import replace

    add = lambda df: df.withColumn(name, encoder(F.col(column)))
    return replace(pair, real=add(pair.real), fake=add(pair.fake))


def lexical_similarity(pair: TablePair, column: str, min_frequency: int = 1) -> DataFrame:
    """One row ``(word_similarity, char_similarity, jaccard, diversity_ratio, overall, rating)``."""
    word = length_similarity(pair, column, "word").select(F.col("similarity").alias("word_similarity"))
    char = length_similarity(pair, column, "char").select(F.col("similarity").alias("char_similarity"))
    vocabulary = vocabulary_overlap(pair, column, min_frequency).select("jaccard", "diversity_ratio")
    row = word.join(F.broadcast(char)).join(F.broadcast(vocabulary))
    overall = (F.col("word_similarity") + F.col("char_similarity") + F.col("jaccard")) / 3
    return row.withColumn("overall", overall).withColumn("rating", LEXICAL.column(F.col("overall")))


def corpus_statistics(pair: TablePair, column: str) -> DataFrame:
    """``(side, n_texts, n_empty, mean_words, std_words, mean_chars, std_chars, vocabulary_size)``, a row a side: 1 real, 0 fake."""
    rows = pair.tagged([column]).select("side", F.col(column).cast("string").alias("text"))
    size = F.size(tokens(F.col("text")))
    sums = rows.groupBy("side").agg(
        F.count("text").alias("n_texts"), F.count(F.when(F.coalesce(F.trim("text"), F.lit("")) == "", 1)).alias("n_empty"),
        *[F.coalesce(f(F.when(F.col("text").isNotNull(), x)), F.lit(0.0)).alias(n) for n, f, x in (("mean_words", F.avg, size), ("std_words", F.stddev_samp, size), ("mean_chars", F.avg, F.length("text")), ("std_chars", F.stddev_samp, F.length("text")))],
    )
    counts = token_counts(pair, column).agg(F.count(F.when(F.col("real") > 0, 1)).alias("s1"), F.count(F.when(F.col("fake") > 0, 1)).alias("s0"))
    return sums.join(F.broadcast(counts)).select("side", "n_texts", "n_empty", "mean_words", "std_words", "mean_chars", "std_chars", F.when(F.col("side") == 1, F.col("s1")).otherwise(F.col("s0")).alias("vocabulary_size"))


def text_similarity(pair: TablePair, column: str, vector_column: str | None = None, **tfidf) -> DataFrame:
    """One row ``(word_length, char_length, vocabulary, tfidf[, semantic], overall)``: up to five scores and their plain mean."""
    row = lexical_similarity(pair, column).select(F.col("word_similarity").alias("word_length"), F.col("char_similarity").alias("char_length"), F.col("jaccard").alias("vocabulary"))
    row = row.join(F.broadcast(tfidf_similarity(pair, column, **tfidf).select(F.col("cosine").alias("tfidf"))))
    if vector_column:
        row = row.join(F.broadcast(embedding_similarity(pair, vector_column).select(F.col("cosine").alias("semantic"))))
    return row.withColumn("overall", _mean(*map(F.col, row.columns)))


def _mean(*parts: Column) -> Column:
    return sum(parts[1:], parts[0]) / len(parts)


def text_evaluation(pair: TablePair, column: str, vector_column: str | None = None, **tfidf) -> DataFrame:
    """One row: lexical, TF-IDF and (with a vector column) semantic similarity, their equal-weighted mean, ratings and consistency."""
    row = lexical_similarity(pair, column).select(F.col("overall").alias("lexical"), "jaccard", "diversity_ratio", F.col("rating").alias("lexical_rating"))
    row = row.join(F.broadcast(tfidf_similarity(pair, column, **tfidf).select(F.col("cosine").alias("tfidf"))))
    parts = [F.col("lexical"), F.col("tfidf")]
    row = row.withColumn("tfidf_rating", TFIDF.column(F.col("tfidf")))
    if vector_column:
        row = row.join(F.broadcast(embedding_similarity(pair, vector_column).select(F.col("cosine").alias("semantic"))))
        row = row.withColumn("semantic_rating", SEMANTIC.column(F.col("semantic")))
        parts.append(F.col("semantic"))
    mean = _mean(*parts)
    spread = F.sqrt(_mean(*[(p - mean) * (p - mean) for p in parts]))
    row = row.withColumns({"overall": mean, "spread": spread})
    return row.withColumns({"rating": TEXT_OVERALL.column(F.col("overall")), "consistency": CONSISTENCY.column(F.col("spread"))})


def quick_text_evaluation(pair: TablePair, column: str) -> DataFrame:
    """One row ``(overall, rating)``: mean of lexical and TF-IDF similarity."""
    return text_evaluation(pair, column).select("overall", "rating")


def all_text_columns(pair: TablePair, quick: bool = False) -> DataFrame:
    """``(column, overall, rating)`` of each text column of the pair."""
    if not pair.text:
        raise ValueError("the pair has no text column")
    out: DataFrame | None = None
    for c in pair.text:
        row = (quick_text_evaluation if quick else text_evaluation)(pair, c).select(F.lit(c).alias("column"), "overall", "rating")
        out = row if out is None else out.unionByName(row)
    return out


