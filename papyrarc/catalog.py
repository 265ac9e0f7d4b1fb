"""All registered queries of the archive operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrarc.plans import browse_queries, html_queries, ledger_queries, scalar_queries, search_queries

MODULES: list = [m.registry for m in (scalar_queries, html_queries, browse_queries, search_queries, ledger_queries)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
