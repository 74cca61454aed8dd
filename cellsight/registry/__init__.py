"""Registered queries: each reads the given tables and, where SQL can say it, carries its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name."""
    def keep(fn):
        from cellsight.registry.inputs import Tables

        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def load_all() -> None:
    from cellsight.registry import evidence, geometry, models, places, raster, releases, stores, streams  # noqa: F401
