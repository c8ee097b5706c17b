"""Registered queries and, where one exists, the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signpost.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Benchmark tables by attribute; a table's schema is read once per query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        frame = table(self.spark, self.folder, name)
        setattr(self, name, frame)
        return frame


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.build = build
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register
