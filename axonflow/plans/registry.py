"""All queries of the library's own operators, by name, with their SQL where there is one."""

from __future__ import annotations

from axonflow.plans import coverage_queries, event_queries, signal_queries, source_queries, table_queries

MODULES = [coverage_queries, event_queries, signal_queries, source_queries, table_queries]


def queries():
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
