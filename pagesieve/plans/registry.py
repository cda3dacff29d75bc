"""Queries by name with the SQL that confirms them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pagesieve.session import reach_workers

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            @wraps(f)
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                reach_workers(spark)
                return f(spark, sf_dir)

            self.queries[f.__name__] = query
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep
