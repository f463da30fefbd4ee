"""Named queries over the driver's tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules that register queries.
MODULES = ("logs_and_checks", "metrics", "answers", "contrasts", "texts", "designs", "additions", "fits")

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) as a query, with its SQL if there is one."""

    def add(function):
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = function
        if sql:
            _sql[name] = sql
        return function

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"quillspark.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
