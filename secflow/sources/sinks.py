"""Sinks: idempotent event tables, topics, rejected records, audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from secflow.sources.tables import written


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_events(batch: DataFrame, path: str, key: str = "dedup_key", time: str = "t", id_column: str = "event_id") -> dict[str, int]:
    """Appends the events whose (tenant, key) the table doesn't hold, by tenant and day; returns how many were new and how many repeated.

    Of a batch's rows with one key the first by (time, id) counts. The batch is computed once,
    into a table of its own that goes when the call ends; what it holds and what was new are
    observed while the two tables are written, so nothing is counted again and other writers
    don't matter. Only the days from the batch's first to its last are read, and a table that
    can't be read is an error, not an empty one. A retry writes nothing twice.
    """
    spark, whole, new = batch.sparkSession, Observation(), Observation()
    dated = batch.withColumn("event_date", F.to_date(F.timestamp_micros(time)))
    held = written(dated.observe(whole, F.count(F.lit(1)).alias("rows"), F.min("event_date").alias("low"), F.max("event_date").alias("high")), "batch")
    try:
        seen = whole.get
        if not seen["rows"]:
            return {"indexed": 0, "duplicates": 0}
        first = F.row_number().over(Window.partitionBy("tenant", key).orderBy(time, id_column))
        fresh = spark.read.schema(dated.schema).parquet(held).withColumn("_first", first).where("_first = 1").drop("_first")
        if exists(spark, path):
            table = spark.read.parquet(path).where(F.col("event_date").between(F.lit(seen["low"]), F.lit(seen["high"])))
            fresh = fresh.join(table.select("tenant", key), ["tenant", key], "left_anti")
        fresh.observe(new, F.count(F.lit(1)).alias("rows")).write.mode("append").partitionBy("tenant", "event_date").parquet(path)
        return {"indexed": new.get["rows"], "duplicates": seen["rows"] - new.get["rows"]}
    finally:
        delete(spark, held)


#: Parts of a tenant's alerts; one is rewritten as a whole.
ALERT_BUCKETS = 64
#: What the alert table holds beside its keys and partitions.
ALERT = ("occurrences", "first_seen", "last_seen", "risk_score", "level", "best_t", "best_id", "applied")


def upsert_alerts(batch: DataFrame, path: str, keys: list[str], batch_id: int, id_column: str = "id", buckets: int = ALERT_BUCKETS) -> None:
    """Merges a batch of alerts (tenant, keys, t, id, occurrences, risk_score, level) into a stored table of one row per tenant and keys.

    Occurrences are added, times widened; the row of highest (risk_score, t, id) gives level
    and risk. The table lies in parts by tenant and bucket of the keys' hash: only the parts
    that the batch touches are read and replaced, all others keep their files. Batch numbers
    of a stream grow; each row remembers the last one that it took, so a batch that is
    repeated after a failure, whole or in part, changes nothing twice. The merged rows are
    staged beside the table first; a stage left by a failed call is put in place, not merged
    again. Null keys are keys of their own; an empty tenant is none, as folders know no other. Nothing is read of rows' earlier events, so a hot
    alert stays one row; ``members`` keeps which ids it has.
    """
    spark, staged = batch.sparkSession, f"{path.rstrip('/')}-staged/batch={batch_id}"
    own = ["tenant", *(k for k in keys if k != "tenant")]
    place = ["tenant", "bucket"]
    if not exists(spark, f"{staged}/_SUCCESS"):
        best = F.struct("risk_score", "t", id_column)
        per = batch.withColumn("tenant", F.nullif("tenant", F.lit(""))).groupBy(*own).agg(F.sum("occurrences").cast("long").alias("occurrences"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.max("risk_score").alias("risk_score"), F.max_by("level", best).alias("level"), F.max(best).alias("_best"))
        fresh = per.select(*own, F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int").alias("bucket"), *ALERT[:5], F.col("_best.t").alias("best_t"), F.col(f"_best.{id_column}").alias("best_id"), F.lit(batch_id).cast("long").alias("applied"))
        merged = fresh
        if exists(spark, path):
            fresh = spark.read.parquet(written(fresh, "fresh-alerts"))
            span = fresh.agg(F.min("tenant"), F.max("tenant"), F.collect_set("bucket")).first()  # at most ``buckets`` numbers
            stored = spark.read.schema(merged.schema).parquet(path).where((F.col("tenant").between(span[0], span[1]) | F.col("tenant").isNull()) & F.col("bucket").isin(span[2]))
            touched = fresh.select(F.col("tenant").alias("_tenant"), F.col("bucket").alias("_bucket")).distinct()
            stored = stored.join(touched, F.col("tenant").eqNullSafe(F.col("_tenant")) & (F.col("bucket") == F.col("_bucket")), "left_semi").select(*fresh.columns)
            merged = _merged(stored, fresh, own)
        merged.write.mode("overwrite").parquet(staged)
    ready = spark.read.parquet(staged)
    ready.repartition(*place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place).parquet(path)
    delete(spark, staged)


def _merged(stored: DataFrame, fresh: DataFrame, own: list[str]) -> DataFrame:
    """Stored and fresh rows to one per key; a fresh row that its key has taken already is let go."""
    kind = F.struct(*ALERT)
    both = stored.select(*own, "bucket", kind.alias("old"), F.lit(None).cast(fresh.select(kind).schema[0].dataType).alias("new")).unionByName(fresh.select(*own, "bucket", F.lit(None).cast(stored.select(kind).schema[0].dataType).alias("old"), kind.alias("new")))
    met = both.groupBy(*own, "bucket").agg(F.first("old", True).alias("old"), F.first("new", True).alias("new"))
    met = met.withColumn("new", F.when(F.col("old").isNull() | (F.col("old.applied") < F.col("new.applied")), F.col("new")))
    rank = lambda side: F.struct(f"{side}.risk_score", f"{side}.best_t", f"{side}.best_id")
    wins = F.col("old").isNull() | (F.col("new").isNotNull() & (rank("new") > rank("old")))
    pick = lambda c: F.when(wins, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    total = F.coalesce("old.occurrences", F.lit(0)) + F.coalesce("new.occurrences", F.lit(0))
    return met.select(*own, "bucket", total.cast("long").alias("occurrences"), F.least("old.first_seen", "new.first_seen").alias("first_seen"), F.greatest("old.last_seen", "new.last_seen").alias("last_seen"), *map(pick, ALERT[3:7]), F.greatest("old.applied", "new.applied").alias("applied"))


def members(batch: DataFrame, path: str, keys: list[str], batch_id: int, id_column: str = "id") -> None:
    """Which ids an alert of ``keys`` has, one row each, in a folder a batch; a repeated batch replaces its own."""
    batch.select(*keys, id_column).distinct().write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def for_topic(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as (key, value) for a topic: keyed by tenant, JSON without nulls."""
    return df.select(F.col("tenant").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def rejected(normalized: DataFrame) -> DataFrame:
    """Records that could not be mapped, with the reason and where they came from."""
    return normalized.where(F.col("error").isNotNull()).select("event_id", "source", "tenant", "error", F.coalesce("raw", "payload").alias("body"))


def audit_rows(changes: DataFrame, entity: str) -> DataFrame:
    """One audit row per change."""
    data = F.to_json(F.struct("from_status", "to_status"))
    return changes.select("tenant", "actor", "action", F.lit(entity).alias("entity_type"), F.col("incident_id").cast("string").alias("entity_id"), data.alias("data"), F.col("t").alias("created_at"))
