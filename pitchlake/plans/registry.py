"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a (spark, sf_dir) function under its name, with DuckDB SQL for the same rows."""

    def register(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


from pitchlake.plans import analytics, bookmarks, catalog, documents, lists, matches, people, playing, series  # noqa: E402,F401  each registers its queries
