"""From raw records to incidents: the whole chain of operators as one set of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.functions import risk
from secflow.operators import correlate, detect, events, normalize, windows
from secflow.sources.tables import written


@dataclass
class Context:
    """What the own organisation is like, as columns over flat events: who runs load tests, which hosts matter."""

    load_test: Column = field(default_factory=lambda: F.lit(False))
    maintenance: Column = field(default_factory=lambda: F.lit(False))
    service: Column = field(default_factory=lambda: F.coalesce(F.col("principal_type") == "Service", F.lit(False)))
    privileged: Column = field(default_factory=lambda: F.lit(False))
    critical: Column = field(default_factory=lambda: F.lit(False))
    criticality: Column = field(default_factory=lambda: F.lit(5))
    internal: tuple[str, ...] = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")


@dataclass
class Tables:
    """Each record ends in one of ``rejected`` or ``events``, each alert in one of ``alerts`` or ``silenced``."""

    rejected: DataFrame
    events: DataFrame
    alerts: DataFrame
    silenced: DataFrame
    hits: DataFrame
    travel: DataFrame
    incidents: DataFrame
    guessed: DataFrame


#: The rules of a taken account, in order, and the seconds that they may take.
TAKEOVER, TAKEOVER_SPAN = ("auth-failures", "auth-success", "idn-role-change", "cred-key"), 1800
TRAVEL_SPAN = 3600
#: A logon after repeated failures.
GUESSED, GUESSED_SPAN = ("auth-failures", "auth-success"), 600


def fired(matches: DataFrame, rules: Sequence[detect.Rule], silence: int) -> DataFrame:
    """Matches that make alerts: those of rules without a threshold, and where a rule's window is full, then none for ``silence`` seconds."""
    plain = [r.id for r in rules if not r.threshold]
    out = matches.where(F.col("rule_id").isin(plain))
    for r in (r for r in rules if r.threshold):
        own = matches.where(F.col("rule_id") == r.id)
        full = windows.threshold(windows.observe(own, ["tenant", "principal"], r.threshold["span"], order=["event_id"]), ">=", r.threshold["count"])
        first = windows.suppress(full, ["tenant", "principal"], silence, ["event_id"]).select("event_id")
        out = out.unionByName(own.join(first, "event_id", "left_semi"))
    return out


def run(raw: DataFrame, rules: Sequence[detect.Rule] = detect.RECORD_RULES, context: Context | None = None, silence: int = 900) -> Tables:
    """Envelopes (event_id, source, tenant, payload, raw, received_at) through normalization, detection, suppression, correlation and scoring.

    Repeated content counts once, by the smallest id. Silenced alerts stay out of correlation.
    Normalized records, events and alerts are written once each to the shared folder, as a
    store would hold them; all later steps read the columns that they need from there.
    """
    c, spark = context or Context(), raw.sparkSession
    done = events.nested(normalize.normalize(raw)).withColumn("faults", F.when(F.col("ocsf").isNotNull(), F.array_join(events.faults(), ",")))
    done = done.withColumn("why", F.coalesce("error", F.nullif("faults", F.lit("")))).select("event_id", "source", "tenant", "why", "ocsf")
    done = spark.read.schema(done.schema).parquet(written(done, "normalized"))
    rejected = done.where("why IS NOT NULL").select("event_id", "source", "tenant", "why")
    flat = events.flat_events(done.where("why IS NULL"))
    first = flat.groupBy("tenant", "dedup_key").agg(F.min("event_id").alias("event_id"))
    flat = spark.read.parquet(written(flat.join(first.select("event_id"), "event_id", "left_semi"), "events"))
    names = risk.signals(source_ip=F.col("source_ip"), internal=list(c.internal), verdict=F.lit(None).cast("string"), class_uid=F.col("class_uid"), status_id=F.col("status_id"), is_mfa=F.col("is_mfa"), time=F.timestamp_micros("t"), privileged=c.privileged, critical=c.critical, service=c.service, load_test=c.load_test, maintenance=c.maintenance)
    seen = flat.withColumn("signals", names).withColumn("_criticality", c.criticality)
    matches = spark.read.parquet(written(detect.match_rules(seen, rules), "matches"))
    made = detect.alerts(fired(matches, rules, silence), rules, F.col("_criticality"), risk.modifier(F.col("signals")))
    made = spark.read.parquet(written(made, "alerts"))
    reason = F.array_join(risk.suppressing(F.col("signals")), ",")
    alerts = made.where(reason == "")
    keyed = alerts.withColumn("key", correlate.group_key([F.col("principal")])).where("key IS NOT NULL")
    window = correlate.temporal_ordered(correlate.in_window(keyed, ["tenant", "key"], TAKEOVER_SPAN, TAKEOVER, "event_id"))
    hits = windows.suppress(window, ["tenant", "key"], TAKEOVER_SPAN, ["event_id"])
    logons = keyed.where("rule_id = 'auth-success'")
    apart = windows.threshold(windows.observe(logons, ["tenant", "key"], TRAVEL_SPAN, "distinct", "country"), ">=", 2)
    travel = windows.suppress(apart, ["tenant", "key"], TRAVEL_SPAN, ["event_id"])
    opened = correlate.temporal_ordered(correlate.in_window(keyed, ["tenant", "key"], GUESSED_SPAN, GUESSED, "event_id"))
    guessed = windows.suppress(opened, ["tenant", "key"], GUESSED_SPAN, ["event_id"])
    # An incident takes the alerts of its window and scores them together.
    span = keyed.join(hits.select("tenant", "key", F.col("t").alias("hit")), ["tenant", "key"]).where(F.col("t").between(F.col("hit") - TAKEOVER_SPAN * windows.SECOND, F.col("hit")))
    per = span.groupBy("tenant", "key", "hit").agg(F.max("risk_score").alias("top"), F.countDistinct("rule_id").alias("rules"), F.size(F.array_distinct(F.flatten(F.collect_set(detect.tactics(F.col("tags")))))).alias("tactics"), F.min("t").alias("first_seen"), F.count(F.lit(1)).alias("alerts"))
    score = risk.incident_score(F.col("top"), F.col("rules"), F.col("tactics"), F.lit(False), F.lit(True))
    incidents = per.withColumn("risk_score", score).select("tenant", F.col("key").alias("principal"), F.lit("account takeover").alias("scenario"), "first_seen", F.col("hit").alias("last_seen"), "alerts", "rules", "risk_score")
    return Tables(rejected, flat, alerts, made.where(reason != "").withColumn("reason", reason), hits, travel, incidents, guessed)
