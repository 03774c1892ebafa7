"""Every query of the lifecycle engine with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.plans import log_queries, model_queries, report_queries

ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {**log_queries.QUERIES, **model_queries.QUERIES, **report_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
