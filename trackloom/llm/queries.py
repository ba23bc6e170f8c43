"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bm25, decontamination, filter_audit, html_text, language_spans, nbest, ngram_join, oracles, ranked_search, revisits, substring_dedup, token_count, token_files, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.digest(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(_read(spark, sf_dir, "documents"))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.report(_read(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_read(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(_read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(_read(spark, sf_dir, "documents"))


def op10_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.neighbours(_read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_spans.report(_read(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece_nbest": op2_sentencepiece_nbest,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_revisits": op5_revisits,
    "op6_ngram_join": op6_ngram_join,
    "op7_html_text": op7_html_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_files": op9_token_files,
    "op10_bm25": op10_bm25,
    "op11_filter_audit": op11_filter_audit,
    "op12_language_spans": op12_language_spans,
    "op13_ranked_search": op13_ranked_search,
}

#: DuckDB SQL for the same rows, where SQL can express them and ends in reasonable time.
ORACLE_SQL: dict[str, str] = {"op1_decontamination": oracles.DECONTAMINATION, "op5_revisits": revisits.REPORT_SQL, "op6_ngram_join": oracles.NGRAM_JOIN, "op8_substring_dedup": oracles.SUBSTRING_DEDUP, "op11_filter_audit": filter_audit.REPORT_SQL, "op13_ranked_search": ranked_search.REPORT_SQL}
