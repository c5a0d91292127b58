"""SLA clocks and response-time metrics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.operators import ranges

MINUTE = 60_000_000
#: Minutes to acknowledge and to resolve by severity, share of the window at which a clock is at risk.
POLICY = {"critical": (15, 240), "high": (60, 480), "medium": (240, 1440), "low": (480, 4320)}
WARN_AT = 0.75
STATES = ("none", "met", "ok", "at_risk", "breached")


def minutes(severity: Column, which: int) -> Column:
    """Minutes of a severity's clock; null where there is none."""
    found = F.when(F.lit(False), F.lit(0))
    for name, limits in POLICY.items():
        found = found.when(severity == name, limits[which])
    return found


def due(created: Column, severity: Column, which: int) -> Column:
    """Deadline of the acknowledge (0) or resolve (1) clock."""
    return created + minutes(severity, which).cast("long") * MINUTE


def clock(created: Column, due_at: Column, done: Column, now: Column) -> Column:
    """none, met, breached, at_risk (from WARN_AT of the window on) or ok."""
    end = F.coalesce(done, now)
    return F.when(due_at.isNull(), "none").when(done.isNotNull() & (done <= due_at), "met").when(end > due_at, "breached").when(now - created >= WARN_AT * (due_at - created), "at_risk").otherwise("ok")


def worse(a: Column, b: Column) -> Column:
    order = F.array(*map(F.lit, STATES))
    return F.element_at(order, F.greatest(F.array_position(order, a), F.array_position(order, b)).cast("int"))


def summarise(df: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Count, mean, median and the positional 90th percentile of non-negative seconds.

    The percentile is the value at place min(floor(n * 0.9), n - 1) of the sorted values, found by counting equal values, so no group is collected.
    """
    own = df.where(F.col(seconds) >= 0)
    counted = own.groupBy(*keys, seconds).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranges.running(counted, keys, [seconds], _before=F.col("_n")).withColumn("_upto", F.col("_before") + F.col("_n"))
    sizes = placed.groupBy(*keys).agg(F.sum("_n").alias("_all")).select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)), "_all")
    same = functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)), F.lit(True))
    placed = placed.join(sizes if keys else F.broadcast(sizes), same)  # one row without keys
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col(seconds)))
    n = F.col("_all")
    return placed.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.round(F.sum(F.col(seconds) * F.col("_n")) / F.sum("_n"), 6).alias("mean"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0).alias("median"),
        at(F.least(F.floor(n * 0.9), n - 1)).alias("p90"),
    )
