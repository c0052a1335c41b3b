"""Quality rules: base counts, and the log-likelihood ratio of two hashed n-gram multinomials.

All of it is DataFrame functions. Words and pairs of words are hashed into
``N_BUCKETS``. The raw multinomial counts every document, the target multinomial
the trusted ones: rows of a labels table with quality 1 that aren't toxic, at
most ``TRUSTED_ROWS`` of them, picked by a hash of the id. A document's score is
the mean over its n-grams of log(target / raw); it is kept if the score is at
least ``MIN_SCORE``. Ratios are held as integers (millionths), so sums don't
depend on order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A power of two.
N_BUCKETS = 8192
TRUSTED_ROWS = 5000
#: Weight, in n-grams, of the prior: the raw distribution itself, so that rare buckets tend to a ratio of 1.
PRIOR_GRAMS = 16 * N_BUCKETS
MIN_SCORE = -0.04
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = "#*$%&|<>"
_GAP = "[ \\t\\n\\x0B\\f\\r]+"
_SCALE = 1_000_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of characters other than 20, 09-0D; none for null."""
    # only the first and the last part of a split can be empty
    lead = lambda p: F.when(F.element_at(p, 1) == "", 1).otherwise(0)
    tail = lambda p: F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)
    return _let(F.split(F.coalesce(text.cast("string"), F.lit("")), _GAP), lambda p: F.slice(p, lead(p) + 1, F.size(p) - lead(p) - tail(p)))


def triples(word_list: Column) -> Column:
    """For each word a struct of it and the two that follow, null beyond the end."""
    rest = lambda k: F.slice(word_list, k + 1, F.greatest(F.size(word_list) - k, F.lit(0)))
    return F.arrays_zip(word_list.alias("a"), rest(1).alias("b"), rest(2).alias("c"))


def repeated_words(zipped: Column) -> Column:
    """How many words lie in windows of three that occur at least twice, from the ``triples`` of a text.

    A text whose windows have no equal hashes is done after one pass; else the
    windows are sorted by hash and words, neighbours are compared word by word, and
    the places that they cover are added up in order, so that a text costs n log n.
    """
    windows = F.slice(zipped, 1, F.greatest(F.size(zipped) - 2, F.lit(0)))
    hashed = F.transform(windows, lambda z: F.xxhash64(z))
    # beyond either end there is no neighbour, which makes the comparison null
    side = lambda ordered, x, k: F.coalesce((F.get(ordered, k)["h"] == x["h"]) & (F.get(ordered, k)["z"] == x["z"]), F.lit(False))
    twice = lambda ordered: F.filter(ordered, lambda x, k: side(ordered, x, k - 1) | side(ordered, x, k + 1))
    covered = lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        placed = F.transform(windows, lambda z, i: F.struct(F.xxhash64(z).alias("h"), z.alias("z"), i.alias("i")))
        starts = F.sort_array(F.transform(_let(F.sort_array(placed), twice), lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(starts, covered))

    return _let(hashed, count).cast("long")


def base_columns(text: Column, word_list: Column, zipped: Column) -> dict[str, Column]:
    plain = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    return {
        "n_words": F.size(word_list).cast("long"),
        "word_chars": F.length(F.array_join(word_list, "")).cast("long"),
        "n_symbols": (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(zipped),
    }


def gram_buckets(z: Column) -> tuple[Column, Column]:
    """The bucket of a word and of it with its successor; the last word's pair is the word alone."""
    mask = F.lit(N_BUCKETS - 1)
    return F.xxhash64(z["a"]).bitwiseAND(mask).cast("int"), F.xxhash64(z["a"], z["b"]).bitwiseAND(mask).cast("int")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", limit: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of trusted rows, ``limit`` at most, as ``trusted_id``: picked by a hash of the id, so that a rerun picks the same."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).cast("long").alias("trusted_id")).where("trusted_id is not null").distinct()
    return good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(limit)


def ratios(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """log(target / raw) of each bucket in millionths; zeros without trusted documents. Raw counts are over all documents."""
    if labels is None:
        return [0] * N_BUCKETS
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # TRUSTED_ROWS rows of eight bytes at most
    rows = rows.join(F.broadcast(trusted_ids(labels, id_col)), F.col("id") == F.col("trusted_id"), "left")
    rows = rows.select(F.col("trusted_id").isNotNull().cast("int").alias("own"), words(F.col("text")).alias("words"))
    each = rows.select("own", F.explode(triples(F.col("words"))).alias("z"))
    each = each.select("own", F.explode(F.array(*gram_buckets(F.col("z")))).alias("bucket"))
    found = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("own").alias("target")).collect()  # N_BUCKETS rows at most
    raw, target = [1.0] * N_BUCKETS, [0.0] * N_BUCKETS
    for r in found:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if not any(target):
        return [0] * N_BUCKETS
    all_raw, all_target = sum(raw), sum(target)
    ratio = lambda t, r: (t * all_raw / r + PRIOR_GRAMS) / (all_target + PRIOR_GRAMS)
    return [round(_SCALE * math.log(ratio(t, r))) for t, r in zip(target, raw, strict=True)]


def assess(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr)``: a row a row of ``docs``.

    A null text has no words. No words give a score of 0. Without trusted rows
    every score is 0, so that the base rules alone decide. Rows that repeat are
    assessed alike and each counts in the raw multinomial. Other columns aren't
    read; an empty table gives an empty result.
    """
    return _assessed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), docs, labels, id_col, text_col, min_score)


def _assessed(rows: DataFrame, docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, min_score: float) -> DataFrame:
    table = F.lit(",".join(map(str, ratios(docs, labels, id_col, text_col))))
    ratio = F.split(table, ",").cast(T.ArrayType(T.IntegerType()))  # folded to one literal by the optimizer
    step = rows.withColumn("__words", words(F.col("__text"))).withColumn("__zipped", triples(F.col("__words")))
    made = base_columns(F.col("__text"), F.col("__words"), F.col("__zipped"))

    def add(total: Column, z: Column) -> Column:
        one, two = gram_buckets(z)
        return total + F.get(ratio, one) + F.get(ratio, two)

    total = F.aggregate("__zipped", F.lit(0).cast("long"), add)
    grams = 2 * F.size("__words")
    llr = F.coalesce(F.try_divide(total.cast("double"), grams.cast("double")) / _SCALE, F.lit(0.0))
    step = step.select(*rows.columns, *[c.alias(k) for k, c in made.items()], llr.alias("llr")).drop("__text")
    step = step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    return step.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= min_score)).select(*[c for c in rows.columns if c != "__text"], *made, "base_failed", "kept", "llr")


def keep_good(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns as they are (whatever their names), that pass the base rules and the score.

    A null or empty text has no words and goes, like every text of fewer than
    ``MIN_WORDS`` words. Rows that repeat stay or go alike; a null id is only not
    trusted. Without trusted rows the base rules alone decide. An empty table gives
    an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_col).alias("__text"))
    # a filter isn't pushed below a projection with the task's number, which would compute the word lists once more for it
    assessed = _assessed(rows, docs, labels, id_col, text_col, min_score).withColumn("__task", F.spark_partition_id())
    return assessed.where("kept and __task >= 0").select("__row.*")
