"""Collects the queries of all modules."""

from __future__ import annotations

from basaltine.plans import (  # noqa: F401
    enrich_queries,
    execution_queries,
    graph_queries,
    join_queries,
    link_queries,
    repository_queries,
    rule_queries,
    service_queries,
    source_queries,
    stream_queries,
    tree_queries,
    verdict_queries,
    view_queries,
)
from basaltine.plans.registry import ORACLE, QUERIES

FLAGSHIP = "severity_rollup"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
