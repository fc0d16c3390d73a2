"""All registered queries of the graph engine and their SQL."""

from __future__ import annotations

from tessera.plans import check_queries, graph_queries, index_queries, pass_queries, report_queries, retrieval_queries, source_queries, text_queries

_MODULES = [graph_queries, text_queries, pass_queries, report_queries, retrieval_queries, source_queries, check_queries, index_queries]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.oracle_sql().items()}
