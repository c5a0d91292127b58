"""Correlation of alerts into scenario hits over sliding windows."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.operators.windows import SECOND, frame


def group_key(*fields: Sequence[Column]) -> Column:
    """The key of a correlation: each field is the first non-null of its sources, lower-cased; null if any is missing."""
    parts = [F.lower(F.coalesce(*sources).cast("string")) for sources in fields]
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, F.concat_ws("|", *parts))


def in_window(alerts: DataFrame, keys: list[str], span: int, rules: Sequence[str], id_column: str = "id") -> DataFrame:
    """The alerts of the rules with what the window that ends at each holds: number of alerts, time of the first, and whether all rules were seen, in any order and in theirs.

    A row carries numbers only, whatever its window holds. ``_chain`` is the latest time at
    which a sequence of all rules, in order, can have begun that ends no later than the row:
    each rule's rows take over the latest beginning that the rule before it reached.
    """
    own = alerts.where(F.col("rule_id").isin(*rules))
    in_order, so_far, w = Window.partitionBy(*keys).orderBy("t", id_column), Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, 0), frame(keys, span)
    began = F.when(F.col("rule_id") == rules[0], F.col("t"))
    for n, rule in enumerate(rules[1:]):
        own = own.withColumn(f"_began{n}", began)
        began = F.when(F.col("rule_id") == rule, F.max(f"_began{n}").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    own = own.withColumn("_chain", began)
    seen = [F.max(F.when(F.col("rule_id") == r, F.col("t"))).over(w).isNotNull() for r in rules]
    made = own.withColumns({"observed": F.count(F.lit(1)).over(w), "first_seen": F.min("t").over(w), "all_seen": functools.reduce(lambda x, y: x & y, seen), "in_order": F.coalesce(F.max("_chain").over(so_far) >= F.col("t") - span * SECOND, F.lit(False))})
    return made.drop("_chain", *(f"_began{n}" for n in range(len(rules) - 1)))


def temporal(df: DataFrame) -> DataFrame:
    """Windows in which every rule was seen, in any order."""
    return df.where("all_seen")


def temporal_ordered(df: DataFrame) -> DataFrame:
    """Windows in which the rules were seen as an ordered subsequence; others may lie between."""
    return df.where("in_order")


def hit_key(tenant: Column, correlation: str, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", tenant, F.lit(correlation), key), 256), 1, 32)
