"""Registration of queries with the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.covers: dict[str, str] = {}

    def add(self, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
        """covers: the inventory rows that the query shows."""

        def keep(query: Query) -> Query:
            self.queries[query.__name__] = query
            self.covers[query.__name__] = covers
            if sql:
                self.sql[query.__name__] = sql
            return query

        return keep
