"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from covaria.llm import bpe, exact_dedup, html_extract, language_id, ngram_join, packing, pitman_yor, quality_rules, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": ngram_join.op1,
        "op2_toxicity": toxicity.op2,
        "op3_language_id": language_id.op3,
        "op4_bpe_round_trip": bpe.op4,
        "op5_harmonic_packing": packing.op5,
        "op6_quality_rules": quality_rules.op6,
        "op7_html_extraction": html_extract.op7,
        "op8_lm_scoring": pitman_yor.op8,
        "op9_token_counts": token_counts.op9,
        "op10_exact_dedup": exact_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.SQL,
        "op6_quality_rules": quality_rules.SQL,
        "op10_exact_dedup": exact_dedup.SQL,
    }
