"""Registered queries of the analytics operators and their SQL."""

from __future__ import annotations

from .plans import beats, editing, events, files, more, paths, series, similarity, structure, transitions

FAMILIES = [series, events, beats, similarity, structure, transitions, paths, editing, files, more]
QUERIES = {name: f for m in FAMILIES for name, f in m.family.queries.items()}
ORACLE_SQL = {name: sql for m in FAMILIES for name, sql in m.family.sql.items()}
