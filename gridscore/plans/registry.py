"""Registered queries: a Spark builder each, and where SQL can say it, the same as plain SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridscore.plans.oracle_views import VIEWS

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(builder: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = builder
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return builder

    return register


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the derived tables it names, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({body.strip()})" for name, body in VIEWS.items() if name in needed)
    text = sql.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"
