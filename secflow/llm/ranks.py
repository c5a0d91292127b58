"""Ranks within groups of any size, without bringing a group together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secflow.llm.common import materialise


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the rank from 0 within the group ``by`` in the order given, and ``n``, the group's rows.

    Two levels: rows are range-sorted by group and order and written, then each range's rows
    are counted per group and the counts added up. A group of a third of all rows lies in a
    third of the ranges, and no window holds more than one row a range of a group. Columns of
    ``by`` hold no nulls; ``order`` should be unique within a group where ranks must agree
    between runs, and columns that start with an underscore are the caller's own risk.
    """
    keys = [*by, *order]
    placed = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("n"))
    ranked = placed.join(starts, [*by, "_range"])
    return ranked.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")
