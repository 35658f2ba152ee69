"""The queries of the operators, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import (
    centroids,
    decontaminate,
    fill_middle,
    html_text,
    licenses,
    lm_scoring,
    near_dups,
    quality,
    substrings,
    subwords,
    suffixes,
    token_counts,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffixes.query,
        "op2_subwords": subwords.query,
        "op3_token_counts": token_counts.query,
        "op4_html_text": html_text.query,
        "op5_decontaminate": decontaminate.query,
        "op6_near_dups": near_dups.query,
        "op7_substring_dedup": substrings.query,
        "op8_lm_scoring": lm_scoring.query,
        "op9_quality_rules": quality.query,
        "op10_license_scan": licenses.query,
        "op11_fill_middle": fill_middle.query,
        "op12_toxicity": toxicity.query,
        "op13_centroids": centroids.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffixes.ORACLE,
        "op6_near_dups": near_dups.ORACLE,
        "op7_substring_dedup": substrings.ORACLE,
        "op9_quality_rules": quality.ORACLE,
        "op11_fill_middle": fill_middle.ORACLE,
        "op13_centroids": centroids.ORACLE,
    }
