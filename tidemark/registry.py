"""Collects the queries of the engine's own operators and their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

FLAGSHIP = "daily_digest"
PLANS = ("digest", "content", "merging", "reads", "subjects", "linking", "ingest", "outputs")

_found: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with the DuckDB SQL for its rows."""

    def keep(f: Callable) -> Callable:
        if f.__name__ in _found:
            raise ValueError(f"two queries are named {f.__name__}")
        _found[f.__name__] = (f, sql)
        return f

    return keep


def _load() -> dict[str, tuple[Callable, str | None]]:
    for name in PLANS:
        importlib.import_module(f"tidemark.plans.{name}")
    return _found


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql}
