"""Named queries with their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltlake.tables import VIEW_SQL, Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(lake)`` as a query; ``sql`` may use the derived views by name."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, path: fn(Lake(spark, path))
        if sql:
            ORACLES[name] = expand(sql)
        return fn

    return wrap


def expand(sql: str) -> str:
    """Prefix the derived views a text names as common table expressions."""
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)]
    views = ", ".join(f"{v} as ({VIEW_SQL[v]})" for v in used)
    text = sql.strip()
    if not used:
        return text
    head = re.match(r"with\s+(recursive\s+)?", text, re.I)
    if head:
        return f"with {head.group(1) or ''}{views}, {text[head.end():]}"
    return f"with {views} {text}"
