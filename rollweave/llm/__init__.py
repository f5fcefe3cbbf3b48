"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from rollweave.llm.entry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
