"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bloom_lm, byte_bpe, exact_dedup, filter_audit, hard_negatives, jaccard_join, line_dedup, near_dedup, pii_bootstrap, quality_rules, source_mix, toxicity, warc_derivatives


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.spans(_documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir))


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_documents(spark, sf_dir))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scores(_documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc_derivatives.derivatives(warc_derivatives.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.withColumn("record_sha256", F.sha2(F.col("record").cast("binary"), 256)).drop("record")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(_documents(spark, sf_dir))


QUERIES = {
    "op1_pii_bootstrap": op1_pii_bootstrap,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_divergence": op4_quality_divergence,
    "op5_bloom_lm": op5_bloom_lm,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_source_mix": op10_source_mix,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_jaccard_join": op13_jaccard_join,
}

# The others are not expressible in SQL over whole tables; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(s) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY s)
    """,
    "op9_warc_derivatives": warc_derivatives.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
