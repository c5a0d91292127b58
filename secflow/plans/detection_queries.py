"""Rule evaluation, windows, suppression, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.functions import risk
from secflow.operators import detect as D
from secflow.operators import windows as W
from secflow.plans.base import ADDRESS_SQL, Book

BOOK = Book()
RULES = D.usable(D.RULES)
GROUPS_LOW = "coalesce(list_transform(groups, lambda x: lower(x)), [])"
#: The DuckDB form of each shipped rule's condition.
DUCK_RULES = {
    "auth-failures": "class_uid = 3002 AND operation = 'Logon' AND status_id = 2 AND NOT starts_with(principal, 'svc-')",
    "auth-success": "class_uid = 3002 AND operation = 'Logon' AND status_id = 1",
    "app-sensitive-read": f"class_uid = 6005 AND starts_with(operation, 'Get') AND contains(hostname, 'prod') AND (list_contains({GROUPS_LOW}, 'admins') OR list_contains({GROUPS_LOW}, 'wheel') OR contains(principal, 'user'))",
    "cloud-no-mfa": "class_uid = 3002 AND operation = 'Logon' AND status_id = 1 AND is_mfa = false",
    "cloud-agent": "class_uid = 3001 AND operation = 'CreateAccessKey' AND coalesce(starts_with(user_agent, 'curl/') OR starts_with(user_agent, 'aws-cli'), false)",
    "cred-key": "class_uid = 3001 AND operation = 'CreateAccessKey' AND NOT starts_with(principal, 'svc-')",
    "end-wheel": f"list_contains({GROUPS_LOW}, 'wheel') AND starts_with(hostname, 'db-')",
    "idn-role-change": "class_uid = 3005 AND operation = 'AttachUserPolicy' AND NOT coalesce(lower(principal) = lower(target_principal), false)",
    "idn-self-grant": "class_uid = 3005 AND operation = 'AttachUserPolicy' AND coalesce(lower(principal) = lower(target_principal), false)",
}
MATCHED = "matched AS (" + " UNION ALL ".join(f"SELECT v_events.*, '{r}' AS rule_id FROM v_events WHERE {c}" for r, c in DUCK_RULES.items()) + ")"
RULE_ROWS = "rules(rule_id, level, severity, confidence) AS (VALUES " + ", ".join(f"('{r.id}', '{r.level}', {risk.LEVELS[r.level]}, {r.confidence})" for r in RULES) + ")"


@BOOK.on("det_match_rules", "v_events", f"WITH {MATCHED} SELECT event_id, rule_id FROM matched")
def match_rules(df: DataFrame) -> DataFrame:
    return D.match_rules(df, RULES).select("event_id", "rule_id")


#: The DuckDB form of each rule's evidence: the searches that matched, and the fields shown, by name.
GROUPS_JSON = """('["' || array_to_string(groups, '","') || '"]')"""
ADMIN = f"(list_contains({GROUPS_LOW}, 'admins') OR list_contains({GROUPS_LOW}, 'wheel'))"
DUCK_EVIDENCE = {
    "auth-failures": ("selection", "operation principal source_ip status_id"),
    "auth-success": ("selection", "hostname operation principal status_id"),
    "app-sensitive-read": ("selection,selection_user", "groups hostname operation principal"),
    "cloud-no-mfa": ("selection", "is_mfa operation principal status_id"),
    "cloud-agent": ("selection,agent", "operation user_agent"),
    "cred-key": ("selection", "operation target_principal"),
    "end-wheel": ("selection", "groups hostname principal"),
    "idn-role-change": ("selection", "operation principal target_principal"),
    "idn-self-grant": ("selection,own", "operation principal"),
}


def _duck_evidence(rule: str, fields: str) -> str:
    forms = {"groups": GROUPS_JSON}
    if rule == "app-sensitive-read":  # the first alternative that holds is shown
        forms = {"groups": f"CASE WHEN {ADMIN} THEN {GROUPS_JSON} END", "principal": f"CASE WHEN NOT {ADMIN} THEN principal END"}
    return "concat_ws(';', " + ", ".join(f"'{f}=' || ({forms.get(f, f)})" for f in fields.split()) + ")"


@BOOK.on("det_evidence", "v_events", f"WITH {MATCHED} SELECT event_id, rule_id, CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{n}'" for r, (n, _) in DUCK_EVIDENCE.items()) + " END AS searches, CASE rule_id " + " ".join(f"WHEN '{r}' THEN {_duck_evidence(r, f)}" for r, (_, f) in DUCK_EVIDENCE.items()) + " END AS evidence FROM matched")
def evidence(df: DataFrame) -> DataFrame:
    """Every match with its searches and the values that made them match, by field name."""
    entries = F.array_sort(F.map_entries("evidence"))
    told = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return D.with_evidence(D.match_rules(df, RULES), RULES).select("event_id", "rule_id", F.array_join("searches", ",").alias("searches"), told.alias("evidence"))


@BOOK.on("det_level_filter", "v_events", f"WITH {MATCHED}, {RULE_ROWS} SELECT rule_id, count(*) AS n FROM matched JOIN rules USING (rule_id) WHERE severity >= 8 GROUP BY rule_id")
def level_filter(df: DataFrame) -> DataFrame:
    return D.match_rules(df, D.usable(D.RULES, "high")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@BOOK.on("det_attack_tags", "v_events", f"""WITH {MATCHED}, tags(rule_id, tactics, techniques) AS (VALUES
  ('auth-failures', 'credential-access', 'T1110'), ('auth-success', 'initial-access', 'T1078'), ('app-sensitive-read', 'collection', 'T1530'), ('cloud-no-mfa', 'initial-access', 'T1078.004'),
  ('cloud-agent', 'persistence', 'T1136'), ('cred-key', 'persistence,credential-access', 'T1098.001'), ('end-wheel', 'privilege-escalation', 'T1548'), ('idn-role-change', 'privilege-escalation', 'T1098'), ('idn-self-grant', 'privilege-escalation', 'T1098'))
  SELECT rule_id, tactics, techniques, count(*) AS n FROM matched JOIN tags USING (rule_id) GROUP BY ALL""")
def attack_tags(df: DataFrame) -> DataFrame:
    found = D.match_rules(df, RULES).join(F.broadcast(D.rule_table(df, RULES)), "rule_id")
    return found.groupBy("rule_id", F.array_join(D.tactics(F.col("tags")), ",").alias("tactics"), F.array_join(D.techniques(F.col("tags")), ",").alias("techniques")).agg(F.count(F.lit(1)).alias("n"))


def _alerts(df: DataFrame) -> DataFrame:
    factor = F.when(F.col("user_id") % 5 == 0, 1.1).otherwise(1.0) * F.when(F.col("principal").startswith("svc-"), 0.85).otherwise(1.0)
    return D.alerts(D.match_rules(df, RULES), RULES, F.when(F.col("hostname").startswith("db-"), 9).otherwise(5), factor)


DUCK_SCORE = """CASE WHEN f >= 1.0::DOUBLE THEN b + least((100.0::DOUBLE - b) * ((f - 1.0::DOUBLE) / (1.6::DOUBLE - 1.0::DOUBLE)), 25.0::DOUBLE * ((f - 1.0::DOUBLE) / (1.6::DOUBLE - 1.0::DOUBLE))) ELSE b * f END"""
DUCK_ALERTS = f"""{MATCHED}, {RULE_ROWS}, rated AS (SELECT *, CASE WHEN starts_with(hostname, 'db-') THEN 9 ELSE 5 END AS crit,
  CASE WHEN user_id % 5 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN starts_with(principal, 'svc-') THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS f FROM matched JOIN rules USING (rule_id)),
 based AS (SELECT *, 100 * pow((severity::DOUBLE / 10) * (confidence::DOUBLE / 10) * (crit::DOUBLE / 10), 1.0::DOUBLE / 3.0::DOUBLE) AS b FROM rated),
 alerts AS (SELECT *, greatest(0, least(100, round_even({DUCK_SCORE}, 0)))::BIGINT AS risk_score,
  substring(sha256(concat_ws('|', tenant, rule_id, principal, source_ip, hostname, session_uid)), 1, 32) AS dedup_key FROM based)"""


@BOOK.on("det_alerts", "v_events", f"WITH {DUCK_ALERTS} SELECT event_id, rule_id, severity, confidence, risk_score, CASE WHEN risk_score >= 90 THEN 'critical' WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 50 THEN 'medium' WHEN risk_score >= 30 THEN 'low' ELSE 'informational' END AS risk_level, principal, source_ip, hostname, t AS first_seen FROM alerts")
def make_alerts(df: DataFrame) -> DataFrame:
    return _alerts(df).select("event_id", "rule_id", "severity", "confidence", "risk_score", "risk_level", "principal", "source_ip", "hostname", F.col("t").alias("first_seen"))


@BOOK.on("det_alert_dedup_key", "v_events", f"WITH {DUCK_ALERTS} SELECT event_id, rule_id, dedup_key, substring(sha256(rule_id || '|' || lower(principal)), 1, 32) AS chosen_key FROM alerts")
def alert_keys(df: DataFrame) -> DataFrame:
    return _alerts(df).select("event_id", "rule_id", "dedup_key", D.dedup_key(F.col("rule_id"), F.lower("principal")).alias("chosen_key"))


@BOOK.on("det_entity_keys", "v_events", "SELECT event_id, 'user:' || lower(principal) || ',ip:' || source_ip || ',host:' || hostname || CASE WHEN k % 2 = 0 THEN ',session:' || session_uid ELSE '' END AS keys FROM v_events")
def entity_keys(df: DataFrame) -> DataFrame:
    session = F.when(F.col("k") % 2 == 0, F.col("session_uid"))
    return df.select("event_id", F.array_join(D.entity_keys(F.col("principal"), F.col("source_ip"), F.col("hostname"), session), ",").alias("keys"))


LOAD_TEST, MAINTENANCE = "(user_id % 13 = 0 AND user_id % 11 <> 0)", "(k % 10 = 0)"


@BOOK.on("det_context_suppressed", "v_events", f"WITH {MATCHED} SELECT event_id, rule_id, concat_ws(',', CASE WHEN {LOAD_TEST} THEN 'load_test_account' END, CASE WHEN {MAINTENANCE} THEN 'known_maintenance_window' END) AS reason FROM matched WHERE {LOAD_TEST} OR {MAINTENANCE}")
def context_suppressed(df: DataFrame) -> DataFrame:
    """Alerts that benign context silences, kept in a table of their own with the reason. A service account alone silences nothing."""
    found = D.match_rules(df, RULES).withColumn("why", risk.suppressing(_signals(df, F.expr(LOAD_TEST), F.expr(MAINTENANCE))))
    return found.where(F.size("why") > 0).select("event_id", "rule_id", F.array_join("why", ",").alias("reason"))


@BOOK.on("det_retro_hunt", "v_events", f"SELECT event_id, t, principal FROM v_events WHERE {DUCK_RULES['idn-role-change']} AND t BETWEEN 1704500000000000 AND 1706000000000000 ORDER BY t DESC, event_id LIMIT 100")
def retro_hunt(df: DataFrame) -> DataFrame:
    rule = [r for r in RULES if r.id == "idn-role-change"]
    pruned = df.where("t BETWEEN 1704500000000000 AND 1706000000000000")
    return D.match_rules(pruned, rule).select("event_id", "t", "principal").orderBy(F.desc("t"), "event_id").limit(100)


@BOOK.on("det_retro_threshold", "v_events", f"SELECT principal, count(*) AS n, count(DISTINCT source_ip) AS addresses FROM v_events WHERE {DUCK_RULES['auth-failures']} GROUP BY principal HAVING count(DISTINCT source_ip) >= 5 ORDER BY n DESC, principal LIMIT 100")
def retro_threshold(df: DataFrame) -> DataFrame:
    rule = [r for r in RULES if r.id == "auth-failures"]
    found = D.match_rules(df, rule).groupBy("principal").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_ip").alias("addresses"))
    return found.where("addresses >= 5").orderBy(F.desc("n"), "principal").limit(100)


@BOOK.on("reg_rule_revisions", "v_events", """WITH s AS (SELECT hostname AS rule_id, t, country || ':' || status_id AS body, event_id FROM v_events),
  c AS (SELECT *, CASE WHEN lag(sha256(body)) OVER w IS DISTINCT FROM sha256(body) THEN 1 ELSE 0 END AS changed FROM s WINDOW w AS (PARTITION BY rule_id ORDER BY t, event_id))
  SELECT rule_id, event_id, changed, CAST(sum(changed) OVER (PARTITION BY rule_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision FROM c""")
def revisions(df: DataFrame) -> DataFrame:
    return revise(df.select(F.col("hostname").alias("rule_id"), "t", "event_id", F.concat_ws(":", "country", F.col("status_id").cast("string")).alias("body"))).select("rule_id", "event_id", "changed", "revision")


def revise(catalogue: DataFrame) -> DataFrame:
    """Rule history: the revision grows whenever the content's hash differs from the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("rule_id").orderBy("t", "event_id")
    changed = catalogue.withColumn("changed", (~F.sha2("body", 256).eqNullSafe(F.lag(F.sha2("body", 256)).over(w))).cast("int"))
    return changed.withColumn("revision", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))


@BOOK.over("reg_referenced_by", "v_alerts", oracle="""WITH c(correlation, ref) AS (VALUES ('brute-force', 'auth-failures'), ('brute-force', 'auth-success'), ('takeover', 'role-change'), ('takeover', 'key-created'), ('takeover', 'missing-rule')),
  r AS (SELECT rule_id, count(*) AS alerts FROM v_alerts GROUP BY rule_id) SELECT c.correlation, c.ref, r.rule_id IS NULL AS unresolved, coalesce(r.alerts, 0) AS alerts FROM c LEFT JOIN r ON c.ref = r.rule_id""")
def referenced_by(alerts: DataFrame) -> DataFrame:
    """Rules that correlations name, with their alerts, and references to no rule."""
    rows = [("brute-force", ["auth-failures", "auth-success"]), ("takeover", ["role-change", "key-created", "missing-rule"])]
    refs = alerts.sparkSession.createDataFrame(rows, "correlation string, refs array<string>").select("correlation", F.explode("refs").alias("ref"))
    counted = alerts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("alerts"))
    return refs.join(counted, F.col("ref") == F.col("rule_id"), "left").select("correlation", "ref", F.col("rule_id").isNull().alias("unresolved"), F.coalesce("alerts", F.lit(0)).alias("alerts"))


# Windows

FAILED = "failed AS (SELECT * FROM v_events WHERE event_type = 'error')"
FRAME = "OVER (PARTITION BY tenant, principal ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)"
KEYS = ["tenant", "principal"]


def failed(df: DataFrame) -> DataFrame:
    return df.where("event_type = 'error'")


@BOOK.on("win_count", "v_events", f"WITH {FAILED}, o AS (SELECT event_id, count(*) {FRAME} AS observed FROM failed) SELECT * FROM o WHERE observed >= 3")
def win_count(df: DataFrame) -> DataFrame:
    return W.threshold(W.observe(failed(df), KEYS, 86400, order=["event_id"]), ">=", 3).select("event_id", "observed")


@BOOK.on("win_distinct", "v_events", f"WITH {FAILED}, o AS (SELECT event_id, count(DISTINCT country) {FRAME} AS observed FROM failed) SELECT event_id, observed FROM o WHERE observed >= 2")
def win_distinct(df: DataFrame) -> DataFrame:
    return W.threshold(W.observe(failed(df), KEYS, 86400, "distinct", "country"), ">=", 2).select("event_id", F.col("observed").cast("long").alias("observed"))


@BOOK.on("win_agg", "v_events", f"WITH {FAILED} SELECT event_id, min(k) {FRAME} AS low, max(k) {FRAME} AS high, CAST(sum(k) {FRAME} AS BIGINT) AS total, round(avg(k) {FRAME}, 6) AS mean FROM failed")
def win_agg(df: DataFrame) -> DataFrame:
    w, out = W.frame(KEYS, 86400), failed(df)
    return out.select("event_id", F.min("k").over(w).alias("low"), F.max("k").over(w).alias("high"), F.sum("k").over(w).alias("total"), F.round(F.avg("k").over(w), 6).alias("mean"))


@BOOK.on("win_threshold", "v_events", f"WITH {FAILED}, o AS (SELECT event_id, count(*) {FRAME} AS n FROM failed) SELECT event_id, n > 2 AS gt, n >= 2 AS ge, n < 2 AS lt, n <= 2 AS le, n = 2 AS eq, n <> 2 AS ne FROM o")
def win_threshold(df: DataFrame) -> DataFrame:
    seen = W.observe(failed(df), KEYS, 86400)
    names = {">": "gt", ">=": "ge", "<": "lt", "<=": "le", "==": "eq", "!=": "ne"}
    return seen.select("event_id", *(W.COMPARE[op](F.col("observed"), 2).alias(n) for op, n in names.items()))


@BOOK.on("win_group_null", "v_events", """WITH f AS (SELECT event_id, t, target_principal AS g FROM v_events WHERE event_type <> 'view')
  SELECT event_id, count(*) OVER (PARTITION BY g ORDER BY t RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS observed, 'target' AS grouping FROM f WHERE g IS NOT NULL
  UNION ALL SELECT event_id, count(*) OVER (ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), '*' FROM v_events WHERE event_type = 'signup'""")
def win_group_null(df: DataFrame) -> DataFrame:
    by_target = W.observe(df.where("event_type <> 'view'"), ["target_principal"], 604800).select("event_id", "observed", F.lit("target").alias("grouping"))
    everyone = W.count_all(df.where("event_type = 'signup'"), 3600, "event_id").select("event_id", "observed", F.lit("*").alias("grouping"))
    return by_target.union(everyone)


@BOOK.on("win_evidence", "v_events", f"WITH {FAILED}, o AS (SELECT event_id, t, count(*) {FRAME} AS observed, min(t) {FRAME} AS first_seen, list(event_id) {FRAME} AS ids FROM failed) SELECT event_id, observed, first_seen, array_to_string(list_sort(ids), ',') AS event_ids FROM o WHERE observed >= 3")
def win_evidence(df: DataFrame) -> DataFrame:
    fired = W.threshold(W.observe(failed(df), KEYS, 86400), ">=", 3).select(*KEYS, "event_id", "t", "observed")
    return W.evidence(fired, failed(df), KEYS, 86400, "event_id").select("event_id", "observed", "first_seen", F.array_join("event_ids", ",").alias("event_ids"))


#: Greedy silence as a recursion over each key's rows in order.
GREEDY = """, n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t, event_id) AS i FROM {source}),
  g AS (SELECT {keys}, t, event_id, i, t AS last, true AS fires FROM n WHERE i = 1
    UNION ALL SELECT {nkeys}, n.t, n.event_id, n.i, CASE WHEN n.t - g.last >= {ttl} THEN n.t ELSE g.last END, n.t - g.last >= {ttl} FROM g JOIN n ON {on} AND n.i = g.i + 1)"""


def greedy(keys: list[str], source: str, ttl: int) -> str:
    return GREEDY.format(keys=", ".join(keys), nkeys=", ".join(f"n.{k}" for k in keys), on=" AND ".join(f"n.{k} = g.{k}" for k in keys), source=source, ttl=ttl * W.SECOND)


@BOOK.on("win_event_dedup", "v_events", f"WITH RECURSIVE x AS (SELECT * FROM v_events){greedy(['hostname', 'event_type', 'country'], 'x', 3600)} SELECT event_id FROM g WHERE fires")
def win_event_dedup(df: DataFrame) -> DataFrame:
    return W.suppress(df, ["hostname", "event_type", "country"], 3600, ["event_id"]).select("event_id")


@BOOK.on("win_suppress", "v_events", f"WITH RECURSIVE {FAILED}, o AS (SELECT event_id, t, tenant, principal, count(*) {FRAME} AS observed FROM failed), x AS (SELECT * FROM o WHERE observed >= 3){greedy(KEYS, 'x', 86400)} SELECT tenant, principal, event_id, t FROM g WHERE fires")
def win_suppress(df: DataFrame) -> DataFrame:
    fired = W.threshold(W.observe(failed(df), KEYS, 86400, order=["event_id"]), ">=", 3)
    return W.suppress(fired, KEYS, 86400, ["event_id"]).select("tenant", "principal", "event_id", "t")


@BOOK.on("win_alert_sessions", "v_alerts", """WITH l AS (SELECT *, CASE WHEN t - lag(t) OVER w >= 7200000000 THEN 1 ELSE 0 END AS fresh FROM v_alerts WINDOW w AS (PARTITION BY tenant, rule_id, hostname ORDER BY t, id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant, rule_id, hostname ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS session FROM l)
  SELECT tenant, rule_id, hostname, min(t) AS first_seen, max(t) AS last_seen, count(*) AS occurrences, max(risk_score) AS risk_score FROM s GROUP BY tenant, rule_id, hostname, session""")
def alert_sessions(df: DataFrame) -> DataFrame:
    parts = W.sessions(df, ["tenant", "rule_id", "hostname"], 7200, False, ["id"])
    return parts.groupBy("tenant", "rule_id", "hostname", "session").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"), F.max("risk_score").alias("risk_score")).drop("session")


# Risk

INTERNAL = ["10.0.0.0/8", "192.168.0.0/16"]


@BOOK.on("risk_context", "v_events", f"""SELECT event_id, concat_ws(',',
  CASE WHEN NOT ({ADDRESS_SQL.format('source_ip')} AND (starts_with(source_ip, '10.') OR starts_with(source_ip, '192.168.'))) THEN 'external_source' END, CASE WHEN k < 5 THEN 'known_malicious_indicator' END, CASE WHEN k BETWEEN 5 AND 9 THEN 'anonymizing_infrastructure' END,
  CASE WHEN class_uid = 3002 AND status_id <> 2 AND is_mfa = false THEN 'no_mfa' END,
  CASE WHEN hour(make_timestamp(t)) < 6 OR hour(make_timestamp(t)) >= 22 OR isodow(make_timestamp(t)) >= 6 THEN 'off_hours' END,
  CASE WHEN list_contains(groups, 'wheel') THEN 'privileged_target' END, CASE WHEN starts_with(hostname, 'db-prod') THEN 'critical_asset_touched' END, CASE WHEN starts_with(principal, 'svc-') THEN 'service_account' END) AS signals FROM v_events""")
def context(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.array_join(_signals(df), ",").alias("signals"))


def _signals(df: DataFrame, load_test: Column | None = None, maintenance: Column | None = None) -> Column:
    verdict = F.when(F.col("k") < 5, "malicious").when(F.col("k") < 10, "vpn")
    return risk.signals(source_ip=F.col("source_ip"), internal=INTERNAL, verdict=verdict, class_uid=F.col("class_uid"), status_id=F.col("status_id"), is_mfa=F.col("is_mfa"), time=F.timestamp_micros("t"), privileged=F.array_contains("groups", "wheel"), critical=F.col("hostname").startswith("db-prod"), service=F.col("principal").startswith("svc-"), load_test=F.lit(False) if load_test is None else load_test, maintenance=maintenance)


DUCK_FACTOR = f"""CASE WHEN NOT ({ADDRESS_SQL.format('source_ip')} AND (starts_with(source_ip, '10.') OR starts_with(source_ip, '192.168.'))) THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN k < 5 THEN 1.3::DOUBLE WHEN k < 10 THEN 1.2::DOUBLE ELSE 1 END
  * CASE WHEN class_uid = 3002 AND status_id <> 2 AND is_mfa = false THEN 1.1::DOUBLE ELSE 1 END
  * CASE WHEN hour(make_timestamp(t)) < 6 OR hour(make_timestamp(t)) >= 22 OR isodow(make_timestamp(t)) >= 6 THEN 1.05::DOUBLE ELSE 1 END
  * CASE WHEN coalesce(list_contains(groups, 'wheel'), false) THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN starts_with(hostname, 'db-prod') THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN starts_with(principal, 'svc-') THEN 0.85::DOUBLE ELSE 1 END"""


@BOOK.on("risk_modifier", "v_events", f"SELECT event_id, round(greatest(0.35::DOUBLE, least(1.6::DOUBLE, {DUCK_FACTOR})), 9) AS factor FROM v_events")
def modifier(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.round(risk.modifier(_signals(df)), 9).alias("factor"))


@BOOK.on("risk_alert_score", "v_events", f"""WITH r AS (SELECT event_id, greatest(0.35::DOUBLE, least(1.6::DOUBLE, {DUCK_FACTOR})) AS f, 100 * pow((2::DOUBLE * severity_id / 10) * (7::DOUBLE / 10) * (CASE WHEN starts_with(hostname, 'db-') THEN 9 ELSE 5 END::DOUBLE / 10), 1.0::DOUBLE / 3.0::DOUBLE) AS b FROM v_events)
  SELECT event_id, greatest(0, least(100, round_even({DUCK_SCORE}, 0)))::BIGINT AS risk_score FROM r""")
def alert_score(df: DataFrame) -> DataFrame:
    score = risk.alert_score(2 * F.col("severity_id"), F.lit(7), F.when(F.col("hostname").startswith("db-"), 9).otherwise(5), risk.modifier(_signals(df)))
    return df.select("event_id", score.alias("risk_score"))


@BOOK.on("risk_band", "v_alerts", "SELECT CASE WHEN risk_score >= 90 THEN 'critical' WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 50 THEN 'medium' WHEN risk_score >= 30 THEN 'low' ELSE 'informational' END AS band, count(*) AS n, min(risk_score) AS low, max(risk_score) AS high FROM v_alerts GROUP BY 1")
def bands(df: DataFrame) -> DataFrame:
    return df.groupBy(risk.band(F.col("risk_score")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("risk_score").alias("low"), F.max("risk_score").alias("high"))


@BOOK.on("risk_level_severity", "v_alerts", "SELECT id, CASE level WHEN 'informational' THEN 1 WHEN 'low' THEN 3 WHEN 'medium' THEN 5 WHEN 'high' THEN 8 ELSE 10 END AS severity FROM v_alerts")
def level_severity(df: DataFrame) -> DataFrame:
    return df.select("id", risk.level_severity(F.col("level")).alias("severity"))


INCIDENTS = "i AS (SELECT incident_id, max(risk_score) AS top, count(DISTINCT rule_id) AS rules, count(DISTINCT tactic) AS tactics, bool_or(risk_score >= 95) AS intel, count(DISTINCT rule_id) = 5 AS complete FROM v_alerts GROUP BY incident_id)"


def by_incident(df: DataFrame) -> DataFrame:
    found = df.groupBy("incident_id").agg(F.max("risk_score").alias("top"), F.countDistinct("rule_id").alias("rules"), F.countDistinct("tactic").alias("tactics"), F.bool_or(F.col("risk_score") >= 95).alias("intel"))
    return found.withColumn("complete", F.col("rules") == 5)


@BOOK.on("risk_incident_score", "v_alerts", f"WITH {INCIDENTS} SELECT incident_id, greatest(0, least(100, round_even(top + (100.0::DOUBLE - top) * (6 * (rules - 1) + 5 * (tactics - 1) + CASE WHEN intel THEN 8 ELSE 0 END + CASE WHEN complete THEN 10 ELSE 0 END) / 100.0::DOUBLE, 0)))::BIGINT AS risk_score FROM i")
def incident_score(df: DataFrame) -> DataFrame:
    return by_incident(df).select("incident_id", risk.incident_score(F.col("top"), F.col("rules"), F.col("tactics"), F.col("intel"), F.col("complete")).alias("risk_score"))


@BOOK.on("risk_factors", "v_alerts", f"""WITH {INCIDENTS} SELECT incident_id, concat_ws('; ', 'highest alert ' || top || '/100', CASE WHEN rules > 1 THEN '+' || 6 * (rules - 1) || ' correlated stages (' || rules || ' distinct detections)' END,
  CASE WHEN tactics > 1 THEN '+' || 5 * (tactics - 1) || ' ATT&CK tactics observed (' || tactics || ')' END, CASE WHEN intel THEN '+8 threat-intel match' END, CASE WHEN complete THEN '+10 full scenario sequence observed' END) AS factors FROM i""")
def factors(df: DataFrame) -> DataFrame:
    return by_incident(df).select("incident_id", explain().alias("factors"))


def explain():
    """The parts of an incident's score in words."""
    return F.concat_ws(
        "; ",
        F.format_string("highest alert %d/100", "top"),
        F.when(F.col("rules") > 1, F.format_string("+%d correlated stages (%d distinct detections)", risk.PER_RULE * (F.col("rules") - 1), F.col("rules"))),
        F.when(F.col("tactics") > 1, F.format_string("+%d ATT&CK tactics observed (%d)", risk.PER_TACTIC * (F.col("tactics") - 1), F.col("tactics"))),
        F.when(F.col("intel"), F.lit(f"+{risk.FOR_INTEL} threat-intel match")),
        F.when(F.col("complete"), F.lit(f"+{risk.FOR_COMPLETE} full scenario sequence observed")),
    )
