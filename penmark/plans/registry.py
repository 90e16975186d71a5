"""Decorator that files a plan and its check SQL under the function's name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
        def register(fn: Plan) -> Plan:
            self.queries[name or fn.__name__] = fn
            if sql:
                self.sql[name or fn.__name__] = sql
            return fn

        return register
