"""Every registered query and its DuckDB counterpart."""

from __future__ import annotations

from commentscan.plans import moderation_queries, scan_queries, source_queries

MODULES = (scan_queries, source_queries, moderation_queries)


def queries():
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
