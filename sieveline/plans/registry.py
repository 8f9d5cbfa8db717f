"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from sieveline.plans import analysis_queries, drift_queries, function_queries, log_queries, nested_queries, retrieval_queries

MODULES = [nested_queries, drift_queries, log_queries, retrieval_queries, analysis_queries, function_queries]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
