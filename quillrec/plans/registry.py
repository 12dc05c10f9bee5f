"""Registry of runnable queries and the SQL text each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillrec.sources.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    """Name a piece of check SQL; later pieces and queries may select from it."""
    VIEWS[name] = body.strip()


def with_views(body: str) -> str:
    """Prefix the SQL with the named pieces it uses, directly or through other pieces."""
    used: set[str] = set()

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", sql):
                used.add(name)
                visit(VIEWS[name])

    visit(body)
    if not used:
        return body.strip()
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in used)
    return f"WITH {parts}\n{body.strip()}"


def query(name: str, sql: str | None = None):
    """Register `build(domain) -> DataFrame` under `name`."""

    def register(build: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Domain(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql)
        return build

    return register
