"""Running totals, interval joins and pairs that never bring a group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.sources.tables import written


def running(rows: DataFrame, by: list[str], order: list[str], /, **totals: Column) -> DataFrame:
    """``rows`` with the total of each given column over all rows before them in their group.

    Two levels: rows are range-sorted by group and order and written; each range's totals per
    group are added up first, and a window inside the range does the rest. A group of any size
    so spreads over ranges. Rows that ``order`` doesn't tell apart come in any order.
    """
    spark, keys = rows.sparkSession, [*by, *order]
    named = rows.withColumns({f"_{n}": c for n, c in totals.items()}).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    placed = spark.read.parquet(written(named, "ranges"))
    group, inside = Window.partitionBy(*by), Window.partitionBy(*by, "_range")
    per = placed.groupBy(*by, "_range").agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n in totals))
    ranges_before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(*(F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_all_{n}").over(ranges_before), F.lit(0)).alias(f"_start_{n}") for n in totals))
    met = placed["_range"] == starts["_at"]
    for i, b in enumerate(by):
        met = met & placed[b].eqNullSafe(starts[f"_by_{i}"])
    rows_before = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.join(starts, met).withColumns({n: F.col(f"_start_{n}") + F.coalesce(F.sum(f"_{n}").over(rows_before), F.lit(0)) for n in totals})
    return summed.select(*rows.columns, *totals)


def ancestors(place: Column, levels: Column) -> Column:
    """The nodes (level, node) of a binary tree over places that hold a place, up to ``levels``."""
    return F.transform(F.sequence(F.lit(0), levels), lambda k: F.struct(k.alias("level"), F.floor(place / F.pow(F.lit(2.0), k)).cast("long").alias("node")))


def cover(low: Column, high: Column, levels: Column) -> Column:
    """The fewest nodes (level, node) that hold exactly the places from ``low`` up to before ``high``: two a level at most."""

    def at(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        left, right = F.ceil(low / size).cast("long"), F.floor(high / size).cast("long")
        node = lambda n: F.struct(k.alias("level"), n.alias("node"))
        return F.array_compact(F.array(F.when((left < right) & (left % 2 == 1), node(left)), F.when((left < right) & (right % 2 == 1), node(right - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), levels), at))


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], point: str, low: str, high: str) -> DataFrame:
    """Pairs of distinct points and the intervals of their group that hold them, by equi-joins only.

    ``point`` is orderable; ``low`` and ``high`` are structs (key, side) of the same order, a
    null one for an open end. Points are ranked within their group and intervals become ranges
    of ranks, each cut into the nodes of a binary tree over the ranks; a point meets the nodes
    above it. No pair is made but those returned, each once.
    """
    spark = points.sparkSession
    place = points.withColumn("_place", F.struct(F.col(point).alias("key"), F.lit(0).alias("side"))).withColumn("_kind", F.lit("point"))
    held = spark.read.parquet(written(intervals.withColumn("_id", F.monotonically_increasing_id()), "intervals"))
    ends = [held.where(F.col(c).isNotNull()).select(*by, F.col(c).alias("_place"), "_id", F.lit(c).alias("_kind")) for c in (low, high)]
    both = place.select(*by, "_place", "_kind", point)
    for end in ends:
        both = both.unionByName(end, allowMissingColumns=True)
    ranked = spark.read.parquet(written(running(both, by, ["_place"], _rank=(F.col("_kind") == "point").cast("long")), "ranks"))
    own = ranked.where("_kind = 'point'").select(*by, point, "_rank")
    sizes = own.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_levels", F.ceil(F.log2(F.greatest("_n", F.lit(2)))).cast("int"))
    rank_of = lambda kind, name: ranked.where(F.col("_kind") == kind).select("_id", F.col("_rank").alias(name))
    cut = held.join(sizes, by).join(rank_of(low, "_from"), "_id", "left").join(rank_of(high, "_upto"), "_id", "left")
    cut = cut.withColumn("_x", F.explode(cover(F.coalesce("_from", F.lit(0)), F.coalesce("_upto", "_n"), F.col("_levels")))).select(*intervals.columns, "_x.*")
    tree = own.join(sizes, by).withColumn("_x", F.explode(ancestors(F.col("_rank"), F.col("_levels")))).select(*by, point, "_x.*")
    return tree.join(cut, [*by, "level", "node"]).drop("level", "node")


def pairs(left: DataFrame, right: DataFrame, by: list[str], size: int = 1024) -> DataFrame:
    """All pairs of rows with equal keys, by an equi-join on blocks of about ``size`` rows a side.

    A key with more rows than that on a side so spreads over tasks; rows of other keys are
    not repeated. Both sides are written first, which fixes each row's block.
    """
    spark = left.sparkSession
    one, two = (spark.read.parquet(written(side.withColumn("_id", F.monotonically_increasing_id()), "pairs")) for side in (left, right))
    counts = lambda side, name: side.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
    many = counts(one, "_rows").join(counts(two, "_columns"), by).where("_rows > 1 OR _columns > 1")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one of its own blocks, once for every block of the other side."""
        blocks = lambda name: F.coalesce(name, F.lit(1))
        at = side.join(many, by, "left").withColumn(f"{own}_at", F.pmod(F.xxhash64("_id"), blocks(own)))
        return at.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0).cast("long"), blocks(other) - 1))).drop("_id", "_rows", "_columns")

    met = dealt(one, "_rows", "_columns").join(dealt(two, "_columns", "_rows"), [*by, "_rows_at", "_columns_at"])
    return met.drop("_rows_at", "_columns_at")
