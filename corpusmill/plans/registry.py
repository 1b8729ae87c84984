"""All queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a query; sql gives the same rows in DuckDB, where SQL can express it."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from corpusmill.plans import corpus, evaluation, files, training  # noqa: F401
