"""The subpackage's queries and their SQL; every operator module has query() and, where SQL can express it, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, cover_tree, filter_audit, language_id, line_dedup, lm_scoring, merkle, mixing, ngram_join, pii, quality_rules, sentencepiece_codec, substring_dedup

MODULES = {
    "op1_quality_rules": quality_rules,
    "op2_sentencepiece": sentencepiece_codec,
    "op3_lm_scoring": lm_scoring,
    "op4_cover_tree": cover_tree,
    "op5_line_dedup": line_dedup,
    "op6_substring_dedup": substring_dedup,
    "op7_ngram_join": ngram_join,
    "op8_pii": pii,
    "op9_language_id": language_id,
    "op10_mixing": mixing,
    "op11_chat_format": chat_format,
    "op12_merkle": merkle,
    "op13_filter_audit": filter_audit,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)}
