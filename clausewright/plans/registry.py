"""All queries of the core and their SQL."""

from __future__ import annotations

from clausewright.plans import pipeline_queries, project_queries, reference_queries

_MODULES = [project_queries, reference_queries, pipeline_queries]


def queries() -> dict:
    """Name to callable(spark, sf_dir)."""
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return {k: s for m in _MODULES for k, s in m.oracle_sql().items()}
