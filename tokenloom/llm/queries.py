"""One query per operator: the operator over its whole table with production parameters,
cut down to the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (best_fit_packing, decontamination, hard_negatives, license_scan, mixing, ngram_jaccard, quality_crf, quality_rules, source_divergence,
               substring_dedup, token_files, toxicity, warc)
from .common import documents, table


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_perplexity", "band_low", "band_high")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("matches")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(documents(spark, sf_dir))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir)).drop("ids")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.classes_of(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, relabelled)


QUERIES = {f.__name__: f for f in (
    op1_spaced_seed_decontamination, op2_quality_rules, op3_license_scan, op4_best_fit_packing, op5_quality_crf, op6_token_files, op7_warc, op8_toxicity,
    op9_ngram_jaccard, op10_substring_dedup, op11_source_divergence, op12_source_mixing, op13_hard_negatives)}

#: Operators that SQL expresses on whole tables in reasonable time.
ORACLE: dict[str, str] = {
    "op1_spaced_seed_decontamination": decontamination.oracle_sql(),
    "op11_source_divergence": source_divergence.oracle_sql(),
    "op12_source_mixing": mixing.oracle_sql(),
    "op13_hard_negatives": hard_negatives.oracle_sql(),
}
