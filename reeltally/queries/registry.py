"""Name -> (query, oracle SQL).  Importing the family modules fills the registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reeltally.queries.oracle_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed(sql: str, found: list[str]) -> list[str]:
    for name, body in VIEWS.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(body, found)
            if name not in found:
                found.append(name)
    return found


def oracle(sql: str) -> str:
    """Prefixes the stand-in views that ``sql`` mentions as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _needed(sql, []))
    sql = sql.strip()
    if not ctes:
        return sql
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add
