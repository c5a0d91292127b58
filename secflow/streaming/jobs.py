"""Structured Streaming jobs that reuse the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.sources.tables import shared_path
from secflow.streaming.processors import rocks


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs a stream over what is there, batch by batch; a second run with the same checkpoint takes up only what is new."""
    where = checkpoint or shared_path(stream.sparkSession, "stream-state")
    with rocks(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(handle).start()
        query.awaitTermination()


def collect_to(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None, per_batch: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Drains a stream into a table, one folder per batch, so that a repeated batch replaces itself; ``per_batch`` shapes each batch first."""
    drain(stream, lambda batch, n: per_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={n}"), mode, checkpoint)
    kind = per_batch(stream).schema
    return stream.sparkSession.read.schema(kind).parquet(path).select(*kind.names)


def counters(stream: DataFrame, width: str, labels: list[str], delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per window of event time and labels; windows overlap where ``slide`` is less than their width."""
    timed = stream.withColumn("_time", F.timestamp_micros("t")).withWatermark("_time", delay)
    return timed.groupBy(F.window("_time", width, slide), *labels).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("window.start").alias("start"), *labels, "n")
