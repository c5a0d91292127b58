"""Registration of queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from secflow.plans.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]

#: DuckDB's test for a version 4 address: other texts lie in no network.
ADDRESS_SQL = r"regexp_full_match({0}, '((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){{3}}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)')"


class Book:
    """The queries of one plan module."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, run: Query, oracle: str | None = None) -> None:
        self.queries[name] = run
        if oracle:
            self.oracles[name] = with_views(oracle)

    def on(self, name: str, source: str, oracle: str | None = None):
        """Registers a function of one view."""

        def put(run: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            self.add(name, lambda spark, sf_dir: run(view(spark, sf_dir, source)), oracle)
            return run

        return put

    def over(self, name: str, *sources: str, oracle: str | None = None):
        """Registers a function of several views."""

        def put(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.add(name, lambda spark, sf_dir: run(*(view(spark, sf_dir, s) for s in sources)), oracle)
            return run

        return put


