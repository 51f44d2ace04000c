"""Registered queries and, where SQL can express them, the DuckDB SQL of the same rows."""

from __future__ import annotations

from trailmill.queries import composites, journal, roads, scalars, tracks

MODULES = (tracks, scalars, journal, roads, composites)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
