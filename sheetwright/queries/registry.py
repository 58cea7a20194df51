"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheetwright.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbers(spark: SparkSession, *bounds: int) -> DataFrame:
    """A column ``id`` of whole numbers, like ``spark.range``."""
    ship(spark)
    return spark.range(*bounds)


class Registry:
    """Collects functions (spark, sf_dir) by name, with DuckDB SQL where there is any."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def take(run):
            self.queries[run.__name__] = run
            if sql:
                self.oracles[run.__name__] = sql
            return run

        return take
