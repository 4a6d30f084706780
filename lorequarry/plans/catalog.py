"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_listing, queries_memory, queries_near, queries_quality, queries_rules, queries_scenes, queries_search, queries_sources, queries_stats, queries_streams

_MODULES = (queries_search, queries_stats, queries_memory, queries_rules, queries_scenes, queries_near, queries_quality, queries_listing, queries_sources, queries_streams)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
