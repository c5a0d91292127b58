"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b): component is the smallest id reachable.

    Each round every node takes the smallest of its neighbours and itself as parent, parents
    are followed twice, and the graph shrinks to the edges between different parents; the
    rounds grow with the logarithm of the longest path. Self-loops and repeated edges do no
    harm. A node with very many edges only ever meets map-side combined minima and joins
    that Spark can split.
    """
    own = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <= b").distinct(), "edges")
    labels = materialise(own.select(F.col("a").alias("id")).union(own.select("b")).distinct().withColumn("component", F.col("id")), "labels")
    own = own.where("a < b")
    while not own.isEmpty():
        both = own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("up"))
            parent = parent.join(up, "p", "left").select("id", F.coalesce("up", "p").alias("p"))
        parent = materialise(parent, "parents")
        labels, old = materialise(labels.join(parent.select(F.col("id").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels"), labels
        mine, theirs = parent.select(F.col("id").alias("a"), F.col("p").alias("pa")), parent.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        moved = own.join(mine, "a").join(theirs, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        own = materialise(moved, "edges")
        discard(edges.sparkSession, old, parent)
    # A label is the smallest id that its component reached so far; it is the smallest of all once no edge is left.
    return labels
