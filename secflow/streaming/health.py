"""Health of a pipeline: hourly counts that micro-batches add up, and the problems that they show."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.operators import ranges

HOUR = 3_600_000_000


def _hour(t: str) -> Column:
    return F.col(t) - F.pmod(F.col(t), F.lit(HOUR))


def counted(batch: DataFrame) -> DataFrame:
    """Hourly counts of a batch's rows (t, taken, failed, code): start, n, failed, server, done. ``done`` counts by the hour in which rows were taken up; null: not yet."""
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    came = F.struct(_hour("t").alias("start"), F.lit(1).cast("long").alias("n"), one(F.col("failed")).alias("failed"), one(F.col("code").between(500, 599)).alias("server"), F.lit(0).cast("long").alias("done"))
    left = F.when(F.col("taken").isNotNull(), F.struct(_hour("taken").alias("start"), *(F.lit(0).cast("long").alias(c) for c in ("n", "failed", "server")), F.lit(1).cast("long").alias("done")))
    sums = [F.sum(c).alias(c) for c in ("n", "failed", "server", "done")]
    return batch.select(F.explode(F.array_compact(F.array(came, left))).alias("_h")).select("_h.*").groupBy("start").agg(*sums)


def problems(parts: DataFrame, failures: int = 10, server: int = 5, least: int = 1, backlog: int = 10_000) -> DataFrame:
    """(start, problem) of every hour from the first to the last with input.

    ``failures`` and ``server`` are the most per cent of failed rows and of answers 500 to
    599, ``least`` the fewest rows, ``backlog`` the most rows that came and weren't taken up by
    the hour's end. An hour without any row is stalled.
    """
    sums = ("n", "failed", "server", "done")
    held = parts.groupBy("start").agg(*(F.sum(c).alias(c) for c in sums))
    span = held.where("n > 0").agg(F.min("start").alias("low"), F.max("start").alias("high")).where("low IS NOT NULL")
    hours = span.select(F.explode(F.sequence("low", "high", F.lit(HOUR))).alias("start")).join(held, "start", "left").na.fill(0)
    open_ = ranges.running(hours, [], ["start"], _before=F.col("n") - F.col("done")).withColumn("_open", F.col("_before") + F.col("n") - F.col("done"))
    tests = {"failure rate": F.col("failed") * 100 > F.col("n") * failures, "little traffic": F.col("n") < least, "stalled": F.col("n") == 0, "server errors": F.col("server") * 100 > F.col("n") * server, "backlog": F.col("_open") > backlog}
    return open_.select("start", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(p)) for p, c in tests.items())))).alias("problem"))


def lag(progress: dict | str) -> int | None:
    """Rows that a stream's sources hold beyond what it has read, by its progress report; null if no source tells."""
    report = json.loads(progress) if isinstance(progress, str) else progress
    behind = [s.get("metrics", {}).get("maxOffsetsBehindLatest") for s in report.get("sources", [])]
    known = [int(b) for b in behind if b is not None]
    return sum(known) if known else None
