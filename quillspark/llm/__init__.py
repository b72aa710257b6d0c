"""Operators for large-scale training-data pipelines. Nothing outside this package imports it."""

from __future__ import annotations

from quillspark.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
