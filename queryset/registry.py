from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when there is one, its SQL."""

    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(ship(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
