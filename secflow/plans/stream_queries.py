"""Sources, sinks and streams, run over what is there and compared with batch results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.functions import histograms as H
from secflow.functions import predicates as P
from secflow.operators import normalize as N
from secflow.plans import case_queries as C
from secflow.plans import detection_queries as D
from secflow.plans import supply_queries as U
from secflow.plans.base import Book
from secflow.plans.normalize_queries import KEY_SQL, raw_records
from secflow.schema import TACTICS
from secflow.sources import logs, sinks
from secflow.sources.tables import shared_path, stream_of, written
from secflow.streaming import health as health_jobs
from secflow.streaming import jobs as J
from secflow.streaming import processors as R

BOOK = Book()

# Sources


def lines(df: DataFrame) -> DataFrame:
    """Log lines: JSON objects with and without their own source, and plain text."""
    full = F.to_json(F.struct(F.lit("app.audit").alias("source"), F.col("message"), F.col("principal").alias("user")))
    bare = F.to_json(F.struct(F.col("principal").alias("user")))
    return df.withColumn("line", F.when(F.col("k") % 3 == 0, full).when(F.col("k") % 3 == 1, bare).otherwise(F.concat(F.lit("plain "), "message")))


ENVELOPE = "CASE WHEN k % 3 = 0 THEN 'app.audit' ELSE 'default' END AS source, k % 3 < 2 AS has_payload, CASE WHEN k % 3 = 0 THEN message WHEN k % 3 = 2 THEN 'plain ' || message END AS raw"
BOOK.on("src_envelope", "v_events", f"SELECT event_id, tenant, {ENVELOPE} FROM v_events")(lambda df: logs.envelope(lines(df), F.col("line"), F.lit("default"), F.col("tenant")).select("event_id", "tenant", "source", F.col("payload").isNotNull().alias("has_payload"), "raw"))
BOOK.on("src_kafka", "v_events", f"SELECT event_id % 3 || '-' || event_id AS \"offset\", tenant, {ENVELOPE.replace('default', 'raw-logs')} FROM v_events")(
    lambda df: logs.from_kafka(lines(df).select(F.col("tenant").cast("binary").alias("key"), F.col("line").cast("binary").alias("value"), F.lit("raw-logs").alias("topic"), (F.col("event_id") % 3).alias("partition"), F.col("event_id").alias("offset"))).select("offset", "tenant", "source", F.col("payload").isNotNull().alias("has_payload"), "raw")
)


@BOOK.on("src_log_files", "v_events", "SELECT 'plain ' || message AS value, count(*) AS n FROM v_events GROUP BY message")
def log_files(df: DataFrame) -> DataFrame:
    """Text files read as a stream in two runs; the second takes up only the new file."""
    spark, folder = df.sparkSession, shared_path(df.sparkSession, "lines")
    text = df.select("event_id", F.concat(F.lit("plain "), "message").alias("value"))
    out, state = shared_path(spark, "read"), shared_path(spark, "state")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        text.where(part).select("value").write.mode("append").text(folder)
        found = J.collect_to(logs.tail_files(spark, folder), out, checkpoint=state)
    return found.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@BOOK.on("src_intel_feed", "v_events", "SELECT 'indicator' AS kind, source_ip AS value, CASE WHEN min(user_id) % 10 = 0 THEN 'malicious' ELSE 'suspicious' END AS verdict, min(user_id)::INT AS score FROM v_events WHERE user_id % 5 = 0 GROUP BY source_ip UNION ALL SELECT 'network', '10.' || user_id % 4 || '.0.0/16', 'suspicious', 1 FROM v_events WHERE user_id % 5 > 1 GROUP BY 2")
def feed(df: DataFrame) -> DataFrame:
    """Feed documents of some hundred entries each, written from the events' addresses and read back as rows."""
    entry = lambda v, s: F.struct(v.alias("verdict"), s.alias("score"))
    one = df.where("user_id % 5 = 0").groupBy("source_ip").agg(F.min("user_id").alias("u"))
    ips = one.select(F.lit(1).alias("g"), F.col("source_ip").alias("v"), entry(F.when(F.col("u") % 10 == 0, "malicious").otherwise("suspicious"), F.col("u").cast("int")).alias("e"))
    nets = df.where("user_id % 5 > 1").select(F.lit(2).alias("g"), F.concat(F.lit("10."), (F.col("user_id") % 4).cast("string"), F.lit(".0.0/16")).alias("v")).distinct().select("g", "v", entry(F.lit("suspicious"), F.lit(1)).alias("e"))
    entries = ips.unionByName(nets)
    many = entries.agg(F.ceil(F.count(F.lit(1)) / 500).alias("documents"))  # one row
    entries = entries.join(F.broadcast(many)).withColumn("document", F.pmod(F.xxhash64("v"), F.greatest("documents", F.lit(1))))
    pick = lambda g: F.map_from_entries(F.collect_list(F.when(F.col("g") == g, F.struct("v", "e"))))
    document = entries.groupBy("document").agg(F.to_json(F.struct(pick(1).alias("indicators"), pick(2).alias("networks"))).alias("value"))
    path = shared_path(df.sparkSession, "feed")
    document.select("value").write.text(path)
    return logs.intel_feed(df.sparkSession.read.text(path), "value").select("kind", "value", "verdict", "score")


@BOOK.over("src_dims", "v_alerts", oracle="WITH o(tactic, tactic_id, ordinal) AS (VALUES " + ", ".join(f"('{s}', '{i}', {n})" for n, (s, i, _) in enumerate(TACTICS)) + ") SELECT tactic_id, ordinal, count(*) AS n FROM v_alerts JOIN o USING (tactic) GROUP BY ALL")
def dims(alerts: DataFrame) -> DataFrame:
    """A fixed dimension broadcast against the alerts."""
    table = alerts.sparkSession.createDataFrame([(s, i, n) for n, (s, i, _) in enumerate(TACTICS)], "tactic string, tactic_id string, ordinal int")
    return alerts.join(F.broadcast(table), "tactic").groupBy("tactic_id", "ordinal").agg(F.count(F.lit(1)).alias("n"))


# Sinks


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("dedup_key", N.content_key(F.col("tenant"), F.col("class_uid"), F.col("activity_id"), F.timestamp_micros("t"), F.col("principal"), F.col("target_principal"), F.col("source_ip"), F.col("hostname"), F.col("status_id"), F.col("operation"), F.lit(None).cast("string"), F.col("message")))


@BOOK.on("snk_events", "v_events", f"SELECT tenant, {KEY_SQL} AS dedup_key, min(event_id) AS event_id FROM v_events GROUP BY ALL")
def event_sink(df: DataFrame) -> DataFrame:
    """Two overlapping batches, one of them twice, leave every event once."""
    own, path = keyed(df).select("tenant", "dedup_key", "event_id", "t"), shared_path(df.sparkSession, "events")
    for part in ("event_id % 10 < 6", "event_id % 10 >= 4", "event_id % 10 >= 4"):
        sinks.write_events(own.where(part), path)
    return df.sparkSession.read.parquet(path).select("tenant", "dedup_key", "event_id")


ALERT_KEYS = ["tenant", "rule_id", "principal"]


@BOOK.on("snk_alerts", "v_alerts", "SELECT tenant, rule_id, principal, CAST(sum(occurrences) AS BIGINT) AS occurrences, min(t) AS first_seen, max(t) AS last_seen, max(risk_score) AS risk_score, arg_max(level, (risk_score, t, id)) AS level, count(*) AS events FROM v_alerts GROUP BY ALL")
def alert_sink(df: DataFrame) -> DataFrame:
    """A stored alert table after three batches, the second of which came twice, with its alerts' events counted."""
    table, ids = shared_path(df.sparkSession, "alerts"), shared_path(df.sparkSession, "alert-events")
    for n, part in ((0, "id % 5 < 2"), (1, "id % 5 = 2"), (1, "id % 5 = 2"), (2, "id % 5 > 2")):
        sinks.upsert_alerts(df.where(part), table, ALERT_KEYS, n, buckets=8)
        sinks.members(df.where(part), ids, ALERT_KEYS, n)
    own = df.sparkSession.read.parquet(ids).select(*ALERT_KEYS, "id").distinct().groupBy(*ALERT_KEYS).agg(F.count(F.lit(1)).alias("events"))
    stored = df.sparkSession.read.parquet(table).select(*ALERT_KEYS, "occurrences", "first_seen", "last_seen", "risk_score", "level")
    return stored.join(own, ALERT_KEYS)


BOOK.on("snk_topics", "v_alerts", """SELECT tenant AS key, '{"id":' || id || ',"rule_id":"' || rule_id || '","risk_score":' || risk_score || '}' AS value FROM v_alerts""")(lambda df: sinks.for_topic(df, ["id", "rule_id", "risk_score"]))
BOOK.on("snk_dlq", "v_events", "SELECT event_id, CASE k % 6 WHEN 4 THEN 'linux.sshd' ELSE 'unknown.x' END AS source, CASE k % 6 WHEN 4 THEN 'unrecognized record' ELSE 'no mapper for source' END AS error FROM v_events WHERE k % 6 >= 4")(lambda df: sinks.rejected(N.normalize(raw_records(df))).select("event_id", "source", "error"))
BOOK.on("snk_audit", "v_actions", """SELECT tenant, actor, action, 'incident' AS entity_type, incident_id::VARCHAR AS entity_id, '{"from_status":"' || from_status || '","to_status":"' || to_status || '"}' AS data FROM v_actions""")(lambda df: df.sparkSession.read.parquet(written(sinks.audit_rows(df, "incident"), "audit")).drop("created_at"))

# Streams


@BOOK.on("st_normalize", "v_events", "SELECT event_id, CASE k % 6 WHEN 1 THEN 'aws.cloudtrail' WHEN 2 THEN 'app' ELSE 'linux' END AS mapper, false AS rejected FROM v_events WHERE k % 6 < 4 UNION ALL SELECT event_id, CASE k % 6 WHEN 4 THEN 'linux' END, true FROM v_events WHERE k % 6 >= 4")
def stream_normalize(df: DataFrame) -> DataFrame:
    """Each micro-batch is normalized once; events and rejects go to tables of their own."""
    spark, good, bad = df.sparkSession, shared_path(df.sparkSession, "good"), shared_path(df.sparkSession, "bad")

    def handle(batch: DataFrame, n: int) -> None:
        done = N.normalize(batch).select("event_id", "mapper", "error").persist()
        done.where("error IS NULL").write.mode("overwrite").parquet(f"{good}/batch={n}")
        done.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{bad}/batch={n}")
        done.unpersist()

    J.drain(stream_of(raw_records(df), "raw"), handle)
    one = spark.read.parquet(good).select("event_id", "mapper", F.lit(False).alias("rejected"))
    return one.unionByName(spark.read.parquet(bad).select("event_id", "mapper", F.lit(True).alias("rejected")))


def as_it_arrives(df: DataFrame, job: Callable[[DataFrame], DataFrame], runs: int = 3, mode: str = "append", per_batch: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """A job over rows that arrive in several runs, one span of time after the other; each run takes up its state where the last one left it."""
    spark, inbox = df.sparkSession, shared_path(df.sparkSession, "inbox")
    out, state = shared_path(spark, "out"), shared_path(spark, "state")
    low, high = df.agg(F.min("t"), F.max("t")).first()
    cuts = [low + (high - low + 1) * n // runs for n in range(runs + 1)] if low is not None else [0, 1]
    for start, end in zip(cuts, cuts[1:], strict=False):
        df.where((F.col("t") >= start) & (F.col("t") < end)).write.mode("append").parquet(inbox)
        found = J.collect_to(job(spark.readStream.schema(df.schema).parquet(inbox)), out, mode, state, per_batch)
    return found


BOOK.on("st_detect", "v_events", D.BOOK.oracles["win_suppress"])(lambda df: as_it_arrives(D.failed(df).select("tenant", "principal", "event_id", "t"), lambda s: R.threshold_alerts(s, ["tenant", "principal"], 86400, 3, 86400)).select("tenant", "principal", "event_id", "t"))
BOOK.on("st_correlate", "v_alerts", C.BOOK.oracles["cor_suppress"])(lambda df: as_it_arrives(df.where(F.col("rule_id").isin(*C.RULES3)).select("tenant", F.lower("principal").alias("key"), "id", "rule_id", "t"), lambda s: R.ordered_hits(s, ["tenant", "key"], C.RULES3, C.SPAN)).select("tenant", "key", "t"))
BOOK.on("st_enrich", "v_events", U.BOOK.oracles["enr_events"])(lambda df: J.collect_to(stream_of(df.select("event_id", "source_ip"), "addresses").join(U.reports(df), F.col("source_ip") == F.col("value"), "left").select("event_id", "verdict", "categories"), shared_path(df.sparkSession, "enriched")))

BOOK.on("st_event_dedup", "v_events", D.BOOK.oracles["win_event_dedup"])(lambda df: as_it_arrives(df.select("hostname", "event_type", "country", "event_id", "t"), lambda s: R.accepted(s, ["hostname", "event_type", "country"], 3600)).select("event_id"))

#: Rows arrive in three runs, each a third of the ids; their times are out of order by up to nine hours.
RUNS, DELAY = 3, 7200
SEEN = "(t - (k % 10) * 3600000000)"
LATE = f"""WITH r AS (SELECT event_id, tenant, hostname, {SEEN} AS seen, ntile({RUNS}) OVER (ORDER BY event_id) AS run FROM v_events),
  m AS (SELECT tenant, hostname, run, max(seen) AS newest FROM r GROUP BY ALL),
  b AS (SELECT r.event_id, r.seen, (SELECT max(newest) FROM m WHERE m.tenant = r.tenant AND m.hostname = r.hostname AND m.run < r.run) AS before FROM r)
  SELECT event_id, coalesce(seen < before - {DELAY} * 1000000::BIGINT, false) AS late FROM b"""


@BOOK.on("st_late_data", "v_events", LATE)
def late(df: DataFrame) -> DataFrame:
    """A stream in three runs; rows older than what their host had sent in earlier runs go to a table of their own."""
    spark, inbox, state = df.sparkSession, shared_path(df.sparkSession, "inbox"), shared_path(df.sparkSession, "state")
    good, bad = shared_path(spark, "on-time"), shared_path(spark, "late")
    rows = df.select("tenant", "hostname", "event_id", F.expr(SEEN).alias("t"))
    # Whole numbers: the first runs hold one row more where they don't divide, as ntile deals them.
    for low, high in _runs(df, RUNS):
        rows.where((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(inbox)

        def handle(batch: DataFrame, n: int) -> None:
            batch.where("late").write.mode("overwrite").parquet(f"{bad}/batch={n}")
            batch.where("NOT late").write.mode("overwrite").parquet(f"{good}/batch={n}")

        J.drain(R.lateness(spark.readStream.schema(rows.schema).parquet(inbox), ["tenant", "hostname"], DELAY), handle, checkpoint=state)
    kind = "event_id long, t long, late boolean"
    return spark.read.schema(kind).parquet(good).union(spark.read.schema(kind).parquet(bad)).select("event_id", "late")


def _runs(df: DataFrame, runs: int) -> list[tuple[int, int]]:
    """Ranges of dense ids, dealt like ntile."""
    low, n = df.agg(F.min("event_id"), F.count(F.lit(1))).first()
    cuts = [low or 0]
    for i in range(runs):
        cuts.append(cuts[-1] + n // runs + (i < n % runs))
    return list(zip(cuts, cuts[1:]))


SILENT = 43200
QUIET = f"""WITH w AS (SELECT hostname, country, t, lead(t) OVER (PARTITION BY hostname, country ORDER BY t, event_id) AS next FROM v_events), m AS (SELECT max(t) // 1000 AS mark FROM v_events)
  SELECT DISTINCT hostname, country, t AS since FROM w, m WHERE next - t >= {SILENT} * 1000000::BIGINT OR (next IS NULL AND -((-t - {SILENT} * 1000000::BIGINT) // 1000) < mark)"""


@BOOK.on("st_silent_sources", "v_events", QUIET)
def quiet(df: DataFrame) -> DataFrame:
    """Pauses of half a day of a host and country; the last ones are told by timers, without a row of theirs."""
    return as_it_arrives(df.select("hostname", "country", "t"), lambda s: R.silent(s, ["hostname", "country"], SILENT)).select("hostname", "country", "since")


@BOOK.on("st_exactly_once", "v_events", f"SELECT tenant, {KEY_SQL} AS dedup_key, min(event_id) AS event_id FROM v_events GROUP BY ALL")
def exactly_once(df: DataFrame) -> DataFrame:
    """A stream replayed from its start, with a lost checkpoint, leaves the table as it was."""
    path = shared_path(df.sparkSession, "events")
    own = stream_of(keyed(df).select("tenant", "dedup_key", "event_id", "t"), "keyed")
    for _ in range(2):
        J.drain(own, lambda batch, n: sinks.write_events(batch, path) and None)
    return df.sparkSession.read.parquet(path).select("tenant", "dedup_key", "event_id")


@BOOK.on("st_window_kind", "v_events", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([t // 43200000000 * 43200000000, t // 43200000000 * 43200000000 - 43200000000]) AS s FROM v_events) GROUP BY ALL")
def window_kind(df: DataFrame) -> DataFrame:
    """Overlapping windows in a stream: each run tells the counts that it changed, and the newest, which is the largest, stands."""
    told = as_it_arrives(df.select("t", "event_type"), lambda s: J.counters(s, "1 day", ["event_type"], slide="12 hours"), mode="update")
    return told.groupBy("start", "event_type").agg(F.max("n").alias("n"))


BOOK.on("st_pipeline_counters", "v_events", "SELECT t // 3600000000 * 3600000000 AS start, event_type, status_id, count(*) AS n FROM v_events GROUP BY ALL")(
    lambda df: J.collect_to(J.counters(stream_of(df.select("t", "event_type", "status_id"), "counted"), "1 hour", ["event_type", "status_id"]), shared_path(df.sparkSession, "counters"), "complete")
)
@BOOK.on("st_latency_quantiles", "v_events", "SELECT t // 86400000000 * 86400000000 AS start, quantile_disc(k, 0.5) AS p50, quantile_disc(k, 0.95) AS p95, quantile_disc(k, 0.99) AS p99 FROM v_events GROUP BY 1")
def latency(df: DataFrame) -> DataFrame:
    """Each micro-batch adds its histograms of five minutes; those of a day are merged when they are asked for. The stream holds no state, so no row comes too late."""
    cut = lambda c, minutes: F.col(c) - F.pmod(F.col(c), F.lit(minutes * 60_000_000))
    parts = as_it_arrives(df.select("t", "k"), lambda s: s, per_batch=lambda batch: H.histogram(batch, [cut("t", 5).alias("start")], F.col("k")))
    days = parts.withColumn("start", cut("start", 1440))
    return H.quantiles(days, ["start"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


#: Answers with 503 (k of 95 and more), and events taken up k minutes after they came; the hour's backlog is what came but wasn't taken up.
BACKLOG = 5
HEALTH = f"""WITH e AS (SELECT t // 3600000000 * 3600000000 AS start, count(*) AS n, count(*) FILTER (WHERE status_id = 2) AS failed, count(*) FILTER (WHERE k >= 95) AS server FROM v_events GROUP BY 1),
  d AS (SELECT (t + k * 60000000) // 3600000000 * 3600000000 AS start, count(*) AS done FROM v_events GROUP BY 1),
  h AS (SELECT unnest(range((SELECT min(start) FROM e), (SELECT max(start) FROM e) + 1, 3600000000)) AS start),
  w AS (SELECT h.start, coalesce(n, 0) AS n, coalesce(failed, 0) AS failed, coalesce(server, 0) AS server, sum(coalesce(n, 0) - coalesce(done, 0)) OVER (ORDER BY h.start) AS backlog FROM h LEFT JOIN e ON e.start = h.start LEFT JOIN d ON d.start = h.start)
  SELECT start, 'failure rate' AS problem FROM w WHERE failed * 100 > n * 35 UNION ALL SELECT start, 'little traffic' FROM w WHERE n < 10 UNION ALL SELECT start, 'stalled' FROM w WHERE n = 0
  UNION ALL SELECT start, 'server errors' FROM w WHERE server * 100 > n * 5 UNION ALL SELECT start, 'backlog' FROM w WHERE backlog > {BACKLOG}"""


@BOOK.on("st_health_alerts", "v_events", HEALTH)
def health(df: DataFrame) -> DataFrame:
    """Hours with a problem, from counts that a stream's micro-batches add up."""
    events = df.select("t", "k", (F.col("status_id") == 2).alias("failed"), F.when(F.col("k") >= 95, 503).otherwise(F.col("http_code")).alias("code"), (F.col("t") + F.col("k") * 60 * 1_000_000).alias("taken"))
    parts = as_it_arrives(events, lambda s: s, per_batch=health_jobs.counted)
    return health_jobs.problems(parts, failures=35, server=5, least=10, backlog=BACKLOG)


SWEPT = 43200
HELD = f"""WITH l AS (SELECT tenant, principal, max(t) AS last FROM v_events GROUP BY ALL), m AS (SELECT max(t) // 1000 AS mark FROM v_events)
  SELECT tenant, principal, last, count(*) AS held FROM v_events JOIN l USING (tenant, principal), m WHERE t >= last - {SWEPT} * 1000000::BIGINT AND -((-last - {SWEPT} * 1000000::BIGINT) // 1000) >= mark GROUP BY ALL"""


@BOOK.on("win_sweep", "v_events", HELD)
def sweep(df: DataFrame) -> DataFrame:
    """Keys whose window the stream still holds after three runs, and how many rows each holds; timers have let the idle ones go."""
    told = as_it_arrives(df.select("tenant", "principal", "t"), lambda s: R.windows(s, ["tenant", "principal"], SWEPT))
    last = told.groupBy("tenant", "principal").agg(F.max_by(F.struct("last", "held", "alive"), F.struct("last", ~F.col("alive"))).alias("w"))
    return last.select("tenant", "principal", "w.*").where("alive").drop("alive")


# Extension points


@BOOK.on("udf_intel_provider", "v_events", "SELECT DISTINCT source_ip AS value, CASE WHEN starts_with(source_ip, '203.') THEN 'malicious' ELSE 'unknown' END AS verdict FROM v_events")
def provider(df: DataFrame) -> DataFrame:
    """A provider of one's own: a function from distinct values to (value, verdict)."""
    own = lambda values: values.withColumn("verdict", F.when(F.col("value").startswith("203."), "malicious").otherwise("unknown"))
    return own(U.addresses(df).distinct())


@BOOK.on("udf_ip_binary", "v_events", "SELECT event_id, k < 50 AS inside FROM v_events")
def ip_binary(df: DataFrame) -> DataFrame:
    """Version 6 addresses against a network; a user's number is their last four groups."""
    groups = F.regexp_replace(F.lpad(F.lower(F.hex("user_id")), 16, "0"), "(.{4})(?=.)", "$1:")
    address = F.concat(F.when(F.col("k") < 50, "2001:db8::").otherwise("2001:dead::"), groups)
    return df.withColumn("a", address).select("event_id", F.coalesce(P.in_network(F.col("a"), "2001:db8::/32"), F.lit(False)).alias("inside"))


BOOK.on("udf_rule_spec", "v_events", "SELECT event_id FROM v_events WHERE operation = 'Logon' AND k > 90")(lambda df: df.where(P.search(df.schema, [{"operation": "logon", "k|gt": 90}])).select("event_id"))
