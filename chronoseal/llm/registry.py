"""Registry of the text-pipeline queries, kept apart from the one of ``plans``."""

from __future__ import annotations

from collections.abc import Callable

from ..plans.base import Query, Runner

QUERIES: dict[str, Query] = {}


def llm_query(sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a function under its own name; ``sql`` is the DuckDB twin."""

    def register(run: Runner) -> Runner:
        QUERIES[run.__name__] = Query(run.__name__, run, (run.__name__.split("_")[0],), sql)
        return run

    return register


def load_queries() -> dict[str, Query]:
    """Import the query module and return the registry."""
    from . import queries  # noqa: F401

    return QUERIES
