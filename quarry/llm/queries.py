"""The registered query of each operator, over whole tables, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import byte_bpe, decontaminate, divergence, filter_audit, html_region, jaccard_join, language_id, maglev, preference, source_divergence, token_counts, wavelet, weak_label
from quarry.llm.scratch import read


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(read(spark, sf_dir, "documents"))


def op4_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_label.score_table(read(spark, sf_dir, "documents"))


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.neighbours(read(spark, sf_dir, "conversations")))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.rule_table(read(spark, sf_dir, "documents"))


def op7_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.place(read(spark, sf_dir, "documents"))


def op8_chunked_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"))


def op9_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_region.extract_pages(read(spark, sf_dir, "pages"))


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.write_and_read(read(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    # several passes, so the table isn't dealt out anew for each
    return language_id.predict_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_template_decontamination,
        op2_token_counts,
        op3_jaccard_join,
        op4_weak_label_quality,
        op5_preference_pairs,
        op6_divergence_rules,
        op7_maglev_sharding,
        op8_chunked_byte_bpe,
        op9_html_region,
        op10_wavelet_tokens,
        op11_language_id,
        op12_filter_audit,
        op13_source_divergence,
    )
}

ORACLES: dict[str, str] = {
    "op1_template_decontamination": decontaminate.oracle(),
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op5_preference_pairs": preference.ORACLE,
    "op6_divergence_rules": divergence.oracle(),
    "op7_maglev_sharding": maglev.oracle(),
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
