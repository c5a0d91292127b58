"""Notes, mentions, watchers and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An @handle that isn't part of an address in prose.
HANDLE = r"(?<![\w.@])@([\w.+-]*\w(?:@[\w.-]*\w)?)"
#: Attempts at a notification and the pause in seconds before each.
ATTEMPTS, PAUSES = 4, (0, 60, 300, 1800)


def handles(notes: DataFrame) -> DataFrame:
    """(id, handle): the distinct handles of each note, lower case."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(HANDLE), F.lit(1)), F.lower))
    return notes.select("id", F.explode(found).alias("handle"))


def mentions(notes: DataFrame, users: DataFrame) -> DataFrame:
    """Each handle's user: by address, else by a local part that one user has; ``ambiguous`` or ``unknown`` otherwise."""
    own = handles(notes)
    people = users.select(F.lower("email").alias("email")).distinct()
    by_local = people.groupBy(F.substring_index("email", "@", 1).alias("local")).agg(F.count(F.lit(1)).alias("holders"), F.min("email").alias("only"))
    found = own.join(people.withColumn("exact", F.col("email")), F.col("handle") == F.col("email"), "left").drop("email").join(by_local, F.col("handle") == F.col("local"), "left")
    state = F.when(F.col("exact").isNotNull() | (F.col("holders") == 1), "resolved").when(F.col("holders") > 1, "ambiguous").otherwise("unknown")
    return found.select("id", "handle", state.alias("state"), F.coalesce("exact", F.when(F.col("holders") == 1, F.col("only"))).alias("email"))


def threads(notes: DataFrame) -> DataFrame:
    """Top-level notes (orphans too) with their replies' ids in order."""
    parents = notes.select(F.col("id").alias("p"), F.col("incident_id").alias("pi"))
    linked = notes.join(parents, (F.col("parent_id") == F.col("p")) & (F.col("incident_id") == F.col("pi")), "left")
    replies = linked.where("p IS NOT NULL").groupBy(F.col("p").alias("top")).agg(F.sort_array(F.collect_list(F.struct("t", "id"))).alias("r"))
    return linked.where("p IS NULL").join(replies, F.col("id") == F.col("top"), "left").select("id", "incident_id", F.coalesce(F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ","), F.lit("")).alias("replies"))


def watchers(reasons: DataFrame) -> DataFrame:
    """One row per (incident, user): the reason given first."""
    return reasons.groupBy("incident_id", "email").agg(F.min_by("reason", F.struct("t", "reason")).alias("reason"), F.min("t").alias("since"))


def retry_due(notifications: DataFrame, now: int) -> DataFrame:
    """Failed notifications whose pause has passed and that may be tried again; times in microseconds."""
    pause = F.element_at(F.array(*map(F.lit, PAUSES)), F.least(F.col("attempts") + 1, F.lit(len(PAUSES))).cast("int"))
    return notifications.where((F.col("status") == "failed") & (F.col("attempts") < ATTEMPTS) & (F.col("last_attempt") + pause.cast("long") * 1_000_000 <= now))
