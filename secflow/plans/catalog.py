"""All registered queries of the security operators, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from secflow.plans import case_queries, detection_queries, normalize_queries, predicate_queries, stream_queries, supply_queries

BOOKS = [predicate_queries.BOOK, detection_queries.BOOK, case_queries.BOOK, supply_queries.BOOK, normalize_queries.BOOK, stream_queries.BOOK]


def queries() -> dict:
    return {name: q for b in BOOKS for name, q in b.queries.items()}


def oracles() -> dict:
    return {name: q for b in BOOKS for name, q in b.oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["det_alerts"](spark, sf_dir)
