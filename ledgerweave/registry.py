"""Names of the registered queries, their callables and the equivalent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("reconciliation", "workflow", "reports", "quality", "lines", "documents", "merging", "tables", "feeds", "shapes", "scalars", "projections")


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` under a name, with the SQL that gives the same rows if there is one."""

    def put(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"ledgerweave.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
