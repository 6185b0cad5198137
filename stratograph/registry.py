"""Named query functions, each with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Query functions by name; ``tool`` metadata makes them discoverable by callers."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep

    def describe(self) -> list[dict[str, str]]:
        """Name and first line of the description of each query, by name."""
        return [{"name": k, "description": (f.__doc__ or "").strip().split("\n")[0]} for k, f in sorted(self.queries.items())]
