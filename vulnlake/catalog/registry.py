"""Register of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vulnlake.views import Data, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Data` under ``name``; ``sql`` is its DuckDB counterpart."""

    def register(build: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return register
