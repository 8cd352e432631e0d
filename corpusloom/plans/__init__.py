"""The registered queries of the library, outside the optional corpus operators."""

from __future__ import annotations


def modules() -> list:
    from . import analytics_queries, document_queries, ingest_queries, search_queries, service_queries, text_queries

    return [text_queries, search_queries, analytics_queries, ingest_queries, document_queries, service_queries]


def queries() -> dict:
    return {k: v for m in modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in modules() for k, v in m.SQL.items()}
