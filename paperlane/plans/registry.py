"""All queries of the core with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlane.plans import case_queries, document_queries, layout_queries, nested_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [nested_queries, document_queries, text_queries, layout_queries, case_queries]


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
