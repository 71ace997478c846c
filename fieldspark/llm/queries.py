"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import compression_quality, decontaminate, filter_audit, hard_negatives, labelled, license_scan, line_dedup, near_duplicates, packing, quality_rules, token_counts, token_files, toxicity, warc
from fieldspark.llm.common import shared_folder, table, written


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(labelled.remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    labels = table(spark, sf_dir, "labels")
    rows = labelled.sample(docs, labels, "quality", ~held_out, compression_quality.PER_CLASS)
    model = compression_quality.fit(rows, labelled.share(labels, "quality", ~held_out))
    return compression_quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(labelled.remainder(F.col("doc_id"), 4) == 2, F.lit(True))
    labels = table(spark, sf_dir, "labels")
    rows = labelled.sample(docs, labels, "toxic", ~held_out, toxicity.PER_CLASS)
    model = toxicity.fit(rows, labelled.share(labels, "toxic", ~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_windows")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    made = written(warc.write(table(spark, sf_dir, "pages"), folder), "warc-archives")
    records = warc.read_archives(made, folder, made.count(), payloads=False)
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
o AS (SELECT d, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.d) AS payload_digest,
       CASE WHEN coalesce(original, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN o ON n >= 1000 AND p.d = o.d"""


def tokenizer(name: str) -> str:
    """A public tokenizer's file; the operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known(spark))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = shared_folder(spark, "tokens"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, sf_dir, "documents")
    made = written(token_files.write(docs, folder, tokenizer("byte_bpe_50k.json"), 2, files), "token-files")
    rows = token_files.read(spark, folder, token_files.with_start(made), ids=False)
    return rows.select("doc_id", F.col("before").alias("start"), "n_tokens", "ids_crc32")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.line_table(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "line_no", "first_doc_id", "first_line_no", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json")
    frequent = token_counts.frequent_lengths(token_counts.sample_files(spark, docs), path)
    return token_counts.count_tokens(docs, path, frequent).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op2_warc": op2_warc,
        "op1_toxicity": op1_toxicity,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_license_scan": op4_license_scan,
        "op5_token_files": op5_token_files,
        "op6_line_dedup": op6_line_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_packing": op8_packing,
        "op9_compression_quality": op9_compression_quality,
        "op10_quality_rules": op10_quality_rules,
        "op11_token_counts": op11_token_counts,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict:
    return {"op2_warc": WARC_SQL, "op4_license_scan": license_scan.oracle(), "op10_quality_rules": quality_rules.oracle(), "op13_filter_audit": filter_audit.oracle()}
