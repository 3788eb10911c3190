"""Query registry: each entry builds a DataFrame from a driver data folder, and may
carry an independent SQL text for the DuckDB oracle.

The oracle text is written against the nine table names; ``with_fixture_ctes`` puts
the table definitions in front of it, since DuckDB only sees the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from qtrlens.sources.fixtures import DerivedTables, with_fixture_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: QueryFn
    sql: str | None
    on: Callable  # tables -> DataFrame


_ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    """Decorator: ``fn(tables) -> DataFrame`` becomes a query, over derived tables."""
    def deco(fn: Callable[[DerivedTables], DataFrame]):
        if name in _ENTRIES:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(DerivedTables(spark, sf_dir))

        build.__name__ = name
        build.__doc__ = fn.__doc__
        _ENTRIES[name] = Entry(name, build, sql, fn)
        return fn
    return deco


def on_tables(name: str, tables) -> DataFrame:
    """A registered query over any tables: derived, stored, bucketed or demo ones."""
    _load_all()
    return _ENTRIES[name].on(tables)


def _load_all() -> None:
    # importing the catalogs fills the registry
    from qtrlens.plans import (catalog_ingest, catalog_insurance, catalog_pivots, catalog_places,  # noqa: F401
                               catalog_signals, catalog_stored, catalog_txn, catalog_users)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: e.build for k, e in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    from qtrlens.plans.sqlx import half_up_rounds
    return {k: half_up_rounds(with_fixture_ctes(e.sql)) for k, e in _ENTRIES.items() if e.sql}
