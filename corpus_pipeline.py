"""The corpus pipeline: five stages, each over all rows that the one before kept.

``STAGES`` lists ``(name, function)``. Each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame; all but the last return the columns of
``docs``. Null, empty and repeated rows follow the operators' own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinscope.llm import bpe, exact_dedup, langid, packing, quality, shared, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; texts without a letter, and undecided ones, go."""
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio, with the labels' good rows as the target."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that link (five-word shingles, similarity 0.8) the row with the smallest doc_id."""
    return simhash.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces, one a row, with their ids; a small store, for the workers hold what other stages left as well."""
    return packing.pack(docs, bpe.default_path("byte_bpe_50k.json"), store=1 << 16)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("exact_dedup", exact), ("simhash_near_dedup", near), ("packing", pack)]

#: The last stage packs ids of a byte-level BPE, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            shared.drop(spark, before)  # it has served: this stage's rows are written
        before = docs.shared_path
    return STAGES[-1][1](spark, docs, sf_dir)
