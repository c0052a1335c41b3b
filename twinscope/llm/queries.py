"""Queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, langid, license_scan, line_dedup, packing, quality, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or bpe.default_path("word_bpe_49k.json")
    ids = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    text = bpe.decode(ids, path)
    return text.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), path or bpe.default_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_turns(rows))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, folder = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return warc.read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_simhash, op4_bpe, op5_line_dedup, op6_quality, op7_license_scan, op8_packing, op9_chat, op10_warc, pipeline)}

ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op5_line_dedup": """
        WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        places AS (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 1, 1))) AS p FROM lines),
        windows AS (SELECT doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS w FROM places),
        ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM windows),
        gone AS (SELECT DISTINCT doc_id, p + d AS p FROM ranked, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
        each_line AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS line FROM lines)
        SELECT e.doc_id, coalesce(string_agg(e.line, chr(10) ORDER BY e.p) FILTER (g.p IS NULL), '') AS text,
               count(*) AS n_lines, count(g.p) AS n_removed
        FROM each_line e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS most FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> most THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> most THEN most END AS refers_to
        FROM m""",
}
