"""Registered queries of the engine's own operators and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import check_queries, log_queries, nested_queries, score_queries, source_queries

FLAGSHIP = "mart"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (log_queries, nested_queries, check_queries, score_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
