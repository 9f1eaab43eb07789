"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import conversations, fingerprint, jaccard, linededup, lm, mixing, packing, quality, secrets, spelling, sql, toxicity, urlfilter, wavelet
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op2(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op3(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op4(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op5(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op6(table(spark, sf_dir, "pages"))


def op7_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.op7(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op9(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op11(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op12(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op13(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_line_dedup": op2_line_dedup,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_url_filters": op6_url_filters,
        "op7_token_wavelet": op7_token_wavelet,
        "op8_source_mixing": op8_source_mixing,
        "op9_document_fingerprints": op9_document_fingerprints,
        "op10_toxicity": op10_toxicity,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_secret_scan": op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": sql.OP1, "op2_line_dedup": sql.OP2, "op5_ngram_jaccard": sql.OP5, "op6_url_filters": urlfilter.ORACLE, "op11_conversation_trie": conversations.ORACLE, "op12_spelling_variants": spelling.ORACLE}
