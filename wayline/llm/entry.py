"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import op01_tokens, op02_html, op03_pii, op04_classifier, op05_substring, op06_decontaminate, op07_minhash, op08_bpe, op09_urls, op10_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op01_tokens.query,
    "op2_html_extraction": op02_html.query,
    "op3_pii_spans": op03_pii.query,
    "op4_quality_classifier": op04_classifier.query,
    "op5_substring_dedup": op05_substring.query,
    "op6_decontamination": op06_decontaminate.query,
    "op7_minhash_near_dedup": op07_minhash.query,
    "op8_bpe_round_trip": op08_bpe.query,
    "op9_url_filters": op09_urls.query,
    "op10_quality_rules": op10_quality.query,
}

ORACLES: dict[str, str] = {
    "op5_substring_dedup": op05_substring.ORACLE,
    "op6_decontamination": op06_decontaminate.ORACLE,
    "op7_minhash_near_dedup": op07_minhash.ORACLE,
    "op9_url_filters": op09_urls.ORACLE,
    "op10_quality_rules": op10_quality.ORACLE,
}
