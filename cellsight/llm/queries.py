"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from cellsight.llm import compression_quality, decontaminate, digest, divergence, importance, language_id, mixing, near_dup, quality_rules, substring_dedup, suffix_dedup, token_files, url_filters

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_decontaminate": decontaminate.query,
    "op4_language_id": language_id.query,
    "op5_token_files": token_files.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_mix_sources": mixing.query,
    "op8_url_filters": url_filters.query,
    "op9_near_dup": near_dup.query,
    "op10_compression_quality": compression_quality.query,
    "op11_importance_resampling": importance.query,
    "op12_source_divergence": divergence.query,
    "op13_fingerprints": digest.query,
}
SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op7_mix_sources": mixing.SQL,
    "op8_url_filters": url_filters.SQL,
    "op9_near_dup": near_dup.SQL,
    "op11_importance_resampling": importance.SQL,
    "op12_source_divergence": divergence.SQL,
}
