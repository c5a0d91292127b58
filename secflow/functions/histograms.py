"""Mergeable histograms of whole numbers: counts per cell, so that partial ones add up in any order.

A number below 2^BITS is its own cell; a larger one falls to the cell of its leading BITS
binary digits, so a cell's lower end is less than 1 / 2^(BITS - 1) below any number in it.
There are at most 64 * 2^(BITS - 1) cells, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 7


def cell(value: Column) -> Column:
    """Lower end of a number's cell; numbers below 0 count as 0, null stays null."""
    v = F.greatest(value.cast("long"), F.lit(0))
    over = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.when(value.isNotNull(), F.call_function("shiftleft", F.call_function("shiftright", v, over), over))


def histogram(df: DataFrame, by: Sequence[Column | str], value: Column) -> DataFrame:
    """Counts per group and cell: the groups' columns, cell, n. Nulls are not counted."""
    return df.where(value.isNotNull()).groupBy(*by, cell(value).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(parts: DataFrame, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles of merged histograms, one row per group: the cell of the first number at or above each share of the count.

    A window sorts a group's cells, never its rows.
    """
    cells = parts.groupBy(*by, "cell").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*by)
    placed = cells.withColumn("_upto", F.sum("n").over(own.orderBy("cell"))).withColumn("_all", F.sum("n").over(own))
    return placed.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * share), F.col("cell"))).alias(name) for name, share in shares.items()))
