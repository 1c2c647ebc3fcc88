"""All registered queries of the market domain and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

_FUNCTIONS: dict[str, Callable] = {}
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a (Context) -> DataFrame function under its name, with its DuckDB twin if SQL can express it."""

    def keep(function: Callable) -> Callable:
        from tidemark.plans.context import Context

        def run(spark, sf_dir):  # noqa: ANN001, ANN202
            return function(Context(spark, sf_dir))

        run.__name__ = function.__name__
        run.__doc__ = function.__doc__
        _FUNCTIONS[function.__name__] = function
        _QUERIES[function.__name__] = run
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return keep


def _load() -> None:
    from tidemark.plans import flat, learning, ledger, market, policies, records, streams, times  # noqa: F401


def functions() -> dict[str, Callable]:
    """The functions of a Context: several queries over one may share what it has written."""
    _load()
    return dict(_FUNCTIONS)


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
