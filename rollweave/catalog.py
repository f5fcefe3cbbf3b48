"""All registered queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollweave.plans import batch_queries, extra_queries, group_queries, registry, text_queries, token_queries  # noqa: F401  (they register)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["dynamic_sampling_grpo"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
