"""How a module registers its queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registered() -> tuple[dict, dict[str, str], Callable]:
    """Queries by name, their SQL by name, and the decorator that adds a function to both."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, view: str = ""):
        """Registers a function under its name, with its SQL behind a view."""

        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = f"WITH {view}\n{sql}" if view else sql
            return f

        return add

    return queries, oracles, query
