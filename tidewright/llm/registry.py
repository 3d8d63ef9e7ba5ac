"""Queries of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from tidewright.llm import decontaminate, fingerprint, jaccard_join, line_dedup, packing, pii, quality, substring_dedup, suffix_dedup, warc

_MODULES = (substring_dedup, line_dedup, warc, packing, quality, fingerprint, pii, suffix_dedup, decontaminate, jaccard_join)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
