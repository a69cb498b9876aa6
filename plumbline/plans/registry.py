"""The registered queries of the audit engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import crawl_queries, history_queries, lookup_queries, page_queries, run_queries, step_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return run_queries.Q | page_queries.Q | step_queries.Q | lookup_queries.Q | crawl_queries.Q | history_queries.Q


def oracle_sql() -> dict[str, str]:
    return run_queries.SQL | page_queries.SQL | step_queries.SQL | lookup_queries.SQL | crawl_queries.SQL | history_queries.SQL
