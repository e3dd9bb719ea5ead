"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from cairn.llm import q_core, q_models, q_pages

MODULES = (q_core, q_pages, q_models)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
