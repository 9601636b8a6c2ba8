"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, language_id, license_scans, line_dedup, mixing, ngram_join, packing, quality_rules, secret_scans, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_mixing": mixing.op3_mixing,
    "op4_language_id": language_id.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_secret_scans": secret_scans.op8_secret_scans,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_license_scans": license_scans.op10_license_scans,
}

ORACLES: dict[str, str] = {
    "op1_url_filters": url_filters.OP1_ORACLE,
    "op2_quality_rules": quality_rules.OP2_ORACLE,
    "op6_line_dedup": line_dedup.OP6_ORACLE,
    "op7_ngram_join": ngram_join.OP7_ORACLE,
    "op9_embedding_dedup": embedding_dedup.OP9_ORACLE,
}
