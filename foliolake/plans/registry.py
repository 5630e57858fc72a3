"""All named queries of the core and their SQL equivalents."""

from __future__ import annotations

from foliolake.plans import corpus_queries, more_queries, pipeline_queries, record_queries, value_queries

MODULES = (record_queries, value_queries, corpus_queries, more_queries, pipeline_queries)
FLAGSHIP = "by_profile"


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
