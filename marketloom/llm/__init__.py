"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("byte_bpe", "exact_dedup", "filter_audit", "katz", "line_dedup", "ngram_join", "secret_scan", "source_divergence", "source_mixing", "topk_search", "toxicity", "url_rules", "warc")


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in import_module(f"marketloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in import_module(f"marketloom.llm.{m}").ORACLE_SQL.items()}
