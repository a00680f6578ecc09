"""The registered queries: each binds an operator to the given tables, with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Modules whose import registers queries.
_MODULES: tuple[str, ...] = tuple(f"quire.plans.{m}" for m in ("scalars", "trees", "editions", "contents", "publishing", "searches", "matches", "governance", "migrations", "operations", "streams"))


def register(name: str, sql: str | None = None):
    """Decorator: the function is the query `name`; `sql` gives the same rows."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    from importlib import import_module

    for m in _MODULES:
        import_module(m)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
