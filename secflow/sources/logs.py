"""Sources: message topics, log files, envelopes, intelligence feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

INDICATOR = "struct<verdict:string,score:int,categories:array<string>,country:string,first_seen:string,last_seen:string>"


def kafka_reader(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 100_000) -> DataStreamReader:
    """A topic stream from the earliest offset, so many records a trigger; the query's checkpoint keeps the offsets."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger)


def from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records to envelopes; the key is the tenant."""
    body = F.col("value").cast("string")
    return envelope(records.withColumn("line", body), F.col("line"), F.col("topic"), F.col("key").cast("string")).withColumn("offset", F.concat_ws("-", F.col("partition").cast("string"), F.col("offset").cast("string")))


def envelope(df: DataFrame, line: Column, source: Column, tenant: Column) -> DataFrame:
    """A line to source, tenant, payload, raw: a JSON object is the payload (its own source, tenant and message win), other text is raw."""
    isobject = F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))
    own = lambda name: F.when(isobject, F.get_json_object(line, f"$.{name}"))
    return df.withColumns({"source": F.coalesce(own("source"), source), "tenant": F.coalesce(own("tenant"), tenant), "payload": F.when(isobject, line), "raw": F.when(isobject, own("message")).otherwise(line)})


def tail_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Lines of text files as a stream: new files are read once each, the checkpoint remembers which."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)


def intel_feed(feed: DataFrame, text: str = "feed") -> DataFrame:
    """A feed document ``{"indicators": {value: {...}}, "networks": {cidr: {...}}}`` to rows."""
    parsed = feed.withColumn("_f", F.from_json(text, f"indicators map<string,{INDICATOR}>, networks map<string,{INDICATOR}>"))
    row = lambda kind: parsed.select(F.lit(kind[:-1]).alias("kind"), F.explode(f"_f.{kind}").alias("value", "v")).select("kind", "value", "v.*")
    return row("indicators").unionByName(row("networks"))
