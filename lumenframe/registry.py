"""Where queries and their SQL register."""

from __future__ import annotations

import re
from collections.abc import Callable

from .sources.fixtures import VIEWS_SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix the fixture views that ``body`` names, in order of dependence."""
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS_SQL:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                need(VIEWS_SQL[name])

    need(body)
    views = ", ".join(f"{name} AS ({VIEWS_SQL[name]})" for name in VIEWS_SQL if name in wanted)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if not views:
        return body
    return f"WITH {head[1] or ''}{views}, {body[head.end():]}" if head else f"WITH {views} {body}"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with DuckDB SQL over the fixture views where SQL can express it."""

    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = with_views(sql)
        return function

    return register
