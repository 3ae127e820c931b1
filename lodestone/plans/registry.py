"""The queries of this library outside llm, with their SQL for an independent check."""

from __future__ import annotations

from . import core, tpch

FAMILIES = (core, tpch)


def queries() -> dict:
    return {name: run for family in FAMILIES for name, run in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLE_SQL.items()}
