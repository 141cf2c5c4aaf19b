"""Shared pieces of the query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Queries by name, with the SQL that gives the same answer where SQL can."""

    queries: dict[str, Query] = field(default_factory=dict)
    oracle: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return register
