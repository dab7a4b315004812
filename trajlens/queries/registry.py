"""Dictionaries that queries register in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Named queries and the SQL that must give the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register a function (spark, sf_dir) -> DataFrame under a name."""

        def register(function):
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = function
            if sql is not None:
                self.oracle[name] = sql
            return function

        return register


REGISTRY = Registry()
query, QUERIES, ORACLE = REGISTRY.query, REGISTRY.queries, REGISTRY.oracle
