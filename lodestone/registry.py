"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir), and its SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def register() -> None:
    """Imports the modules of queries."""
    from lodestone.plans import histories, ingests, lookups, reports, risks, structures, texts  # noqa: F401
