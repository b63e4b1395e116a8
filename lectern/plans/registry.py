"""One decorator that registers a query with its oracle."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict[str, str] = {}

    def register(sql: str | None = None):
        def take(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return take

    return queries, oracles, register
