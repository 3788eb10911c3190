"""Choose where the nine tables come from (S17): the driver data (derived lazily),
tables written by the ETL, or the synthetic demo tables when there is no data.
All three offer the same interface (attributes per table, ``table(name)``)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def open_tables(spark: SparkSession, source: str = "derived", path: str | None = None, seed: int = 42):
    """``source``: ``"derived"`` (driver Parquet folder ``path``), ``"stored"`` (folder
    written by ``materialize``/``load_all``) or ``"synthetic"`` (no input needed)."""
    if source == "derived":
        from qtrlens.sources.fixtures import DerivedTables
        return DerivedTables(spark, _need(path, source))
    if source == "stored":
        from qtrlens.sources.fixtures import StoredTables
        return StoredTables(spark, _need(path, source))
    if source == "synthetic":
        from qtrlens.sources.synth import SyntheticTables
        return SyntheticTables(spark, seed)
    raise ValueError("source must be 'derived', 'stored' or 'synthetic'")


def _need(path: str | None, source: str) -> str:
    if not path:
        raise ValueError(f"source={source!r} needs a path")
    return path
