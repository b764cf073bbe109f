"""Query registry: a name, a Spark callable and (where SQL can say it) the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(spark, sf_dir))

        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
