"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arm_queries, audit_queries, eval_queries, graph_queries, report_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **graph_queries.QUERIES, **eval_queries.QUERIES, **arm_queries.QUERIES, **report_queries.QUERIES, **audit_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**text_queries.ORACLE_SQL, **graph_queries.ORACLE_SQL, **eval_queries.ORACLE_SQL, **arm_queries.ORACLE_SQL, **report_queries.ORACLE_SQL, **audit_queries.ORACLE_SQL}
