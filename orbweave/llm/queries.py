"""The queries and DuckDB SQL of this subpackage's operators."""

from __future__ import annotations

from . import byte_bpe, decontamination, exact_dedup, language_id, near_dedup, pii, quality, sharding, substring_dedup, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_language_id": language_id.op3_language_id,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality": quality.op5_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_pii": pii.op10_pii,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_near_dedup": near_dedup.SQL,
}
