"""Correlation, incidents, cases, timelines, SLA and SOC metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secflow.functions import risk
from secflow.operators import correlate as C
from secflow.operators import incidents as I
from secflow.operators import metrics as M
from secflow.operators import windows as W
from secflow.plans.base import Book
from secflow.schema import TACTICS

BOOK = Book()
NOW = 946_684_800_000_000  # the metrics' fixed present: 2000-01-01
OPEN = "status <> 'closed'"

# Aggregates

BOOK.on("agg_events_by_class", "v_events", "SELECT CASE class_uid WHEN 3001 THEN 'Account Change' WHEN 3002 THEN 'Authentication' WHEN 3005 THEN 'User Access Management' ELSE class_uid::VARCHAR END AS label, count(*) AS n FROM v_events WHERE t >= 1705000000000000 GROUP BY 1")(
    lambda df: df.where("t >= 1705000000000000").groupBy(F.coalesce(F.create_map(*(F.lit(x) for p in ((3001, "Account Change"), (3002, "Authentication"), (3005, "User Access Management")) for x in p))[F.col("class_uid")], F.col("class_uid").cast("string")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
)
BOOK.on("agg_events_by_severity", "v_events", "SELECT CASE severity_id WHEN 1 THEN 'Informational' WHEN 2 THEN 'Low' WHEN 4 THEN 'High' ELSE 'Unknown' END AS label, count(*) AS n FROM v_events GROUP BY 1")(
    lambda df: df.groupBy(F.coalesce(F.create_map(*(F.lit(x) for p in ((1, "Informational"), (2, "Low"), (4, "High")) for x in p))[F.col("severity_id")], F.lit("Unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
)


@BOOK.on("agg_terms_buckets", "v_events", "SELECT g AS term, count(*) AS n, count(DISTINCT principal) AS users FROM (SELECT DISTINCT event_id, principal, unnest(groups) AS g FROM v_events) GROUP BY g HAVING count(*) >= 10 AND count(DISTINCT principal) > 1 ORDER BY n DESC, g LIMIT 3")
def terms_buckets(df: DataFrame) -> DataFrame:
    """Multi-valued fields count once per value."""
    values = df.select("event_id", "principal", F.explode(F.array_distinct("groups")).alias("term"))
    found = values.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("principal").alias("users"))
    return found.where("n >= 10 AND users > 1").orderBy(F.desc("n"), "term").limit(3)


@BOOK.on("agg_alert_counts", "v_alerts", "SELECT tenant, count(*) AS total, count(*) FILTER (WHERE is_building_block) AS building_blocks, count(*) FILTER (WHERE risk_score >= 90) AS critical, count(*) FILTER (WHERE risk_score BETWEEN 70 AND 89) AS high, count(*) FILTER (WHERE status <> 'closed') AS open FROM v_alerts GROUP BY tenant")
def alert_counts(df: DataFrame) -> DataFrame:
    n = lambda e: F.count_if(F.expr(e))
    return df.groupBy("tenant").agg(F.count(F.lit(1)).alias("total"), n("is_building_block").alias("building_blocks"), n("risk_score >= 90").alias("critical"), n("risk_score BETWEEN 70 AND 89").alias("high"), n("status <> 'closed'").alias("open"))


@BOOK.on("agg_detection_stats", "v_alerts", "SELECT rule_id, level, count(*) AS alerts FROM v_alerts WHERE t >= 1706000000000000 GROUP BY GROUPING SETS ((rule_id), (level))")
def detection_stats(df: DataFrame) -> DataFrame:
    return df.where("t >= 1706000000000000").groupingSets([["rule_id"], ["level"]], "rule_id", "level").agg(F.count(F.lit(1)).alias("alerts"))


@BOOK.over("agg_overview", "v_alerts", "v_incidents", oracle="SELECT (SELECT count(*) FROM v_alerts) AS alerts, (SELECT CAST(sum(occurrences) AS BIGINT) FROM v_alerts) AS occurrences, (SELECT count(DISTINCT rule_id) FROM v_alerts) AS rules, (SELECT count(*) FROM v_incidents) AS incidents, (SELECT count(*) FROM v_incidents WHERE status <> 'closed') AS open, (SELECT max(risk_score) FROM v_incidents) AS top_risk")
def overview(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    one = alerts.agg(F.count(F.lit(1)).alias("alerts"), F.sum("occurrences").alias("occurrences"), F.countDistinct("rule_id").alias("rules"))
    two = incidents.agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.expr(OPEN)).alias("open"), F.max("risk_score").alias("top_risk"))
    return one.join(F.broadcast(two), F.lit(True))  # one row each


@BOOK.over("agg_mitre_coverage", "v_alerts", oracle="WITH t(tactic, ordinal, name) AS (VALUES " + ", ".join(f"('{s}', {i}, '{n}')" for i, (s, _, n) in enumerate(TACTICS)) + "), a AS (SELECT tactic, count(*) AS alerts, count(DISTINCT technique) AS techniques, count(DISTINCT incident_id) AS incidents FROM v_alerts GROUP BY tactic) SELECT ordinal, name, coalesce(alerts, 0) AS alerts, coalesce(techniques, 0) AS techniques, coalesce(incidents, 0) AS incidents FROM t LEFT JOIN a USING (tactic) ORDER BY ordinal")
def coverage(alerts: DataFrame) -> DataFrame:
    rows = [(s, i, n) for i, (s, _, n) in enumerate(TACTICS)]
    dimension = alerts.sparkSession.createDataFrame(rows, "tactic string, ordinal int, name string")
    counts = alerts.groupBy("tactic").agg(F.count(F.lit(1)).alias("alerts"), F.countDistinct("technique").alias("techniques"), F.countDistinct("incident_id").alias("incidents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return dimension.join(counts, "tactic", "left").select("ordinal", "name", zero("alerts"), zero("techniques"), zero("incidents")).orderBy("ordinal")


@BOOK.over("agg_team_counts", "v_incidents", "v_teams", oracle="SELECT team, count(i.id) AS open, count(i.id) FILTER (WHERE assignee IS NULL) AS unclaimed FROM v_teams t LEFT JOIN v_incidents i ON i.team_id = t.team_id AND status <> 'closed' GROUP BY team")
def team_counts(incidents: DataFrame, teams: DataFrame) -> DataFrame:
    opened = incidents.where(OPEN).groupBy("team_id").agg(F.count(F.lit(1)).alias("open"), F.count_if(F.col("assignee").isNull()).alias("unclaimed"))
    return teams.join(opened, "team_id", "left").select("team", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("unclaimed", F.lit(0)).alias("unclaimed"))


# Correlation

RULES3 = ["auth-failures", "auth-success", "role-change"]
SPAN = 172800
BY = "OVER (PARTITION BY tenant, key ORDER BY t RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)"
KEYED = "keyed AS (SELECT *, lower(principal) AS key FROM v_alerts WHERE rule_id IN ('auth-failures', 'auth-success', 'role-change'))"
ORDERED = "position('auth-failures' IN seq) > 0 AND regexp_matches(seq, 'auth-failures,.*auth-success,.*role-change,')"
SEQ = f"s AS (SELECT *, list(struct_pack(t := t, id := id, r := rule_id)) {BY} AS l FROM keyed), q AS (SELECT *, array_to_string(list_transform(list_sort(l), lambda x: x.r), ',') || ',' AS seq FROM s)"


def keyed(df: DataFrame) -> DataFrame:
    return C.in_window(df.withColumn("key", C.group_key([F.col("principal")])), ["tenant", "key"], SPAN, RULES3)


@BOOK.on("cor_group_key", "v_alerts", "SELECT id, CASE WHEN id % 3 = 0 THEN lower(principal) || '|' || lower(hostname) WHEN is_building_block THEN NULL ELSE lower(source_ip) || '|' || lower(hostname) END AS key FROM v_alerts")
def group_key(df: DataFrame) -> DataFrame:
    """The principal, else the address from evidence; no key where all sources are missing."""
    own = F.when(F.col("id") % 3 == 0, F.col("principal"))
    evidence = F.when(~F.col("is_building_block"), F.col("source_ip"))
    return df.select("id", C.group_key([own, evidence], [F.col("hostname")]).alias("key"))


@BOOK.on("cor_event_count", "v_alerts", f"WITH {KEYED}, c AS (SELECT id, count(*) {BY} AS observed FROM keyed) SELECT * FROM c WHERE observed >= 4")
def event_count(df: DataFrame) -> DataFrame:
    return keyed(df).where("observed >= 4").select("id", F.col("observed").cast("long").alias("observed"))


@BOOK.on("cor_value_count", "v_alerts", f"WITH {KEYED}, c AS (SELECT id, count(DISTINCT country) {BY} AS countries FROM keyed) SELECT * FROM c WHERE countries >= 3")
def value_count(df: DataFrame) -> DataFrame:
    own = df.where(F.col("rule_id").isin(*RULES3)).withColumn("key", C.group_key([F.col("principal")]))
    return W.observe(own, ["tenant", "key"], SPAN, "distinct", "country").where("observed >= 3").select("id", F.col("observed").cast("long").alias("countries"))


@BOOK.on("cor_temporal", "v_alerts", f"WITH {KEYED}, c AS (SELECT id, count(DISTINCT rule_id) {BY} AS rules FROM keyed) SELECT id FROM c WHERE rules = 3")
def temporal(df: DataFrame) -> DataFrame:
    return C.temporal(keyed(df)).select("id")


@BOOK.on("cor_temporal_ordered", "v_alerts", f"WITH {KEYED}, {SEQ} SELECT id FROM q WHERE {ORDERED}")
def temporal_ordered(df: DataFrame) -> DataFrame:
    return C.temporal_ordered(keyed(df)).select("id")


HITS = f"WITH RECURSIVE {KEYED}, {SEQ}, h AS (SELECT *, id AS event_id FROM q WHERE {ORDERED})" + """, n AS (SELECT *, row_number() OVER (PARTITION BY tenant, key ORDER BY t, event_id) AS i FROM h),
  g AS (SELECT tenant, key, t, event_id, i, t AS last, true AS fires FROM n WHERE i = 1 UNION ALL
    SELECT n.tenant, n.key, n.t, n.event_id, n.i, CASE WHEN n.t - g.last >= 172800000000 THEN n.t ELSE g.last END, n.t - g.last >= 172800000000 FROM g JOIN n ON n.tenant = g.tenant AND n.key = g.key AND n.i = g.i + 1)"""


def hits(df: DataFrame) -> DataFrame:
    found = C.temporal_ordered(keyed(df)).withColumn("event_id", F.col("id"))
    return W.suppress(found, ["tenant", "key"], SPAN, ["event_id", "first_seen", "observed"])


@BOOK.on("cor_suppress", "v_alerts", f"{HITS} SELECT tenant, key, t FROM g WHERE fires")
def cor_suppress(df: DataFrame) -> DataFrame:
    return hits(df).select("tenant", "key", "t")


@BOOK.on("cor_hit", "v_alerts", f"{HITS} SELECT g.tenant, g.key, g.t AS last_seen, h.l[1].t AS ignored, list_min(list_transform(h.l, lambda x: x.t)) AS first_seen, len(h.l)::BIGINT AS alerts, substring(sha256(g.tenant || '|takeover|' || g.key), 1, 32) AS hit_key FROM g JOIN h ON h.event_id = g.event_id AND h.tenant = g.tenant WHERE g.fires".replace("h.l[1].t AS ignored, ", ""))
def cor_hit(df: DataFrame) -> DataFrame:
    return hits(df).select("tenant", "key", F.col("t").alias("last_seen"), "first_seen", F.col("observed").alias("alerts"), C.hit_key(F.col("tenant"), "takeover", F.col("key")).alias("hit_key"))


# Alerts and incidents

@BOOK.on("alert_upsert", "v_alerts", "SELECT tenant, rule_id, principal, CAST(sum(occurrences) AS BIGINT) AS occurrences, min(t) AS first_seen, max(t) AS last_seen, array_to_string(list_sort(list(id)), ',') AS event_ids, max(risk_score) AS risk_score, arg_max(level, (risk_score, t, id)) AS level FROM v_alerts GROUP BY tenant, rule_id, principal")
def upsert(df: DataFrame) -> DataFrame:
    merged = I.upsert_alerts(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["tenant", "rule_id", "principal"])
    return merged.withColumn("event_ids", F.array_join("event_ids", ","))


@BOOK.on("alert_status_changes", "v_alerts", "SELECT tenant, rule_id, principal, arg_max(status, (t, id)) AS status FROM v_alerts GROUP BY ALL")
def status_changes(df: DataFrame) -> DataFrame:
    return I.latest(df, ["tenant", "rule_id", "principal"], "status", ["t", "id"])


@BOOK.on("inc_from_hits", "v_alerts", f"{HITS} SELECT g.tenant, g.key AS principal, 'takeover' AS scenario, g.t AS last_seen, len(h.l)::BIGINT AS alerts FROM g JOIN h ON h.event_id = g.event_id AND h.tenant = g.tenant WHERE g.fires")
def from_hits(df: DataFrame) -> DataFrame:
    return hits(df).select("tenant", F.col("key").alias("principal"), F.lit("takeover").alias("scenario"), F.col("t").alias("last_seen"), F.col("observed").alias("alerts"))


@BOOK.on("inc_from_alerts", "v_alerts", f"WITH {KEYED}, {SEQ}, used AS (SELECT DISTINCT tenant, principal FROM q WHERE {ORDERED}) SELECT id, tenant, risk_score FROM v_alerts a WHERE risk_score >= 70 AND NOT is_building_block AND NOT EXISTS (SELECT 1 FROM used u WHERE u.tenant = a.tenant AND u.principal = a.principal)")
def from_alerts(df: DataFrame) -> DataFrame:
    """Risky alerts of principals that no scenario covers."""
    used = C.temporal_ordered(keyed(df)).select("tenant", "principal").distinct()
    return df.where((F.col("risk_score") >= I.OPENS_AT) & ~F.col("is_building_block")).join(used, ["tenant", "principal"], "left_anti").select("id", "tenant", "risk_score")


@BOOK.on("inc_sessions", "v_alerts", """WITH l AS (SELECT *, CASE WHEN t - lag(t) OVER w > 21600000000 THEN 1 ELSE 0 END AS fresh FROM v_alerts WINDOW w AS (PARTITION BY tenant, principal ORDER BY t, id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant, principal ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS session FROM l)
  SELECT tenant, principal, min(t) AS first_seen, max(t) AS last_seen, count(*) AS alerts, max(risk_score) AS risk_score, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules FROM s GROUP BY tenant, principal, session""")
def incident_sessions(df: DataFrame) -> DataFrame:
    parts = W.sessions(df, ["tenant", "principal"], 21600, True, ["id"])
    return parts.groupBy("tenant", "principal", "session").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count(F.lit(1)).alias("alerts"), F.max("risk_score").alias("risk_score"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules")).drop("session")


@BOOK.on("inc_keys", "v_incidents", "SELECT id, 'INC-' || (2000 + row_number() OVER (PARTITION BY tenant ORDER BY created, id)) AS key FROM v_incidents")
def keys(df: DataFrame) -> DataFrame:
    return I.numbered(df, "tenant", ["created", "id"]).select("id", "key")


LINKED = "o AS (SELECT technique || '-' || source_ip AS alert, arg_max(incident_id, (t, id)) AS incident_id FROM v_alerts GROUP BY 1)"


def ownership(df: DataFrame) -> DataFrame:
    alert = df.withColumn("alert", F.concat_ws("-", "technique", "source_ip"))
    return I.latest(alert, ["alert"], "incident_id", ["t", "id"])


@BOOK.on("inc_link_alerts", "v_alerts", f"WITH {LINKED} SELECT alert, incident_id, 'correlated' AS status FROM o")
def link_alerts(df: DataFrame) -> DataFrame:
    return ownership(df).withColumn("status", F.lit("correlated"))


@BOOK.on("inc_supersede", "v_alerts", f"WITH {LINKED}, a AS (SELECT incident_id, arg_max(technique || '-' || source_ip, (t, id)) AS alert FROM v_alerts GROUP BY incident_id) SELECT a.incident_id, o.incident_id AS absorbed_by FROM a JOIN o USING (alert) WHERE a.incident_id NOT IN (SELECT incident_id FROM o)")
def supersede(df: DataFrame) -> DataFrame:
    """Incidents left without alerts, and the one that took their last alert."""
    owned = ownership(df)
    last = I.latest(df.withColumn("alert", F.concat_ws("-", "technique", "source_ip")), ["incident_id"], "alert", ["t", "id"])
    left = last.join(owned.select("incident_id").distinct(), "incident_id", "left_anti")
    return left.join(owned.select("alert", F.col("incident_id").alias("absorbed_by")), "alert").select("incident_id", "absorbed_by")


MERGE = "m AS (SELECT i.*, CASE WHEN id % 10 = 7 AND status <> 'closed' THEN id - 7 ELSE id END AS survivor FROM v_incidents i)"


@BOOK.on("inc_merge", "v_incidents", f"WITH {MERGE} SELECT survivor, count(*) AS merged, min(first_seen) AS first_seen, max(created) AS last_created, max(risk_score) AS risk_score, array_to_string(list_sort(list(DISTINCT principal)), ',') AS principals FROM m GROUP BY survivor")
def merge(df: DataFrame) -> DataFrame:
    """Open incidents whose id ends in 7 fold into the one that ends in 0; closed ones are refused."""
    mapped = df.withColumn("survivor", F.when((F.col("id") % 10 == 7) & F.expr(OPEN), F.col("id") - 7).otherwise(F.col("id")))
    return mapped.groupBy("survivor").agg(F.count(F.lit(1)).alias("merged"), F.min("first_seen").alias("first_seen"), F.max("created").alias("last_created"), F.max("risk_score").alias("risk_score"), F.array_join(F.array_sort(F.collect_set("principal")), ",").alias("principals"))


@BOOK.on("inc_merge_preview", "v_incidents", "SELECT a.id AS keep, b.id AS duplicate, a.risk_score AS before, greatest(a.risk_score, b.risk_score) AS after FROM v_incidents a JOIN v_incidents b ON b.id = a.id + 7 WHERE b.id % 10 = 7 AND b.status <> 'closed'")
def merge_preview(df: DataFrame) -> DataFrame:
    kept = df.select(F.col("id").alias("keep"), F.col("risk_score").alias("before"))
    gone = df.where("id % 10 = 7").where(OPEN).select((F.col("id") - 7).alias("keep"), F.col("id").alias("duplicate"), "risk_score")
    return kept.join(gone, "keep").select("keep", "duplicate", "before", F.greatest("before", "risk_score").alias("after"))


CANON = "c AS (SELECT DISTINCT CASE WHEN kind = 'related' THEN least(a, b) ELSE a END AS a, CASE WHEN kind = 'related' THEN greatest(a, b) ELSE b END AS b, kind FROM v_links WHERE a <> b)"
BOOK.on("link_canonical", "v_links", f"WITH {CANON} SELECT * FROM c")(I.canonical_links)
BOOK.on("link_view", "v_links", f"WITH {CANON} SELECT a AS incident, b AS other, kind AS relation FROM c UNION ALL SELECT b, a, CASE kind WHEN 'duplicate_of' THEN 'duplicated_by' WHEN 'child_of' THEN 'parent_of' ELSE kind END FROM c")(lambda df: I.link_view(I.canonical_links(df)))
BOOK.on("link_unlink", "v_links", f"WITH {CANON}, g AS (SELECT DISTINCT least(a, b) AS low, greatest(a, b) AS high FROM v_links WHERE a % 9 = 0) SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM g WHERE least(c.a, c.b) = low AND greatest(c.a, c.b) = high)")(lambda df: I.without_pairs(I.canonical_links(df), df.where("a % 9 = 0").select("b", "a")))

# Routing

ROUTES = [("r-crit", 10, 1, ["critical"], None, None, None), ("r-risk", 20, 2, None, None, 90, None), ("r-user", 20, 3, ["high", "medium"], "^user1[0-4]", None, None), ("r-low", 30, 4, None, None, None, 20), ("r-gone", 5, 99, None, "^user99@", None, None)]
DUCK_ROUTES = """r(rule, priority, team, severities, pattern, min_risk, max_risk) AS (VALUES ('r-crit', 10, 1, ['critical'], NULL, NULL::INT, NULL::INT), ('r-risk', 20, 2, NULL, NULL, 90, NULL), ('r-user', 20, 3, ['high', 'medium'], '^user1[0-4]', NULL, NULL), ('r-low', 30, 4, NULL, NULL, NULL, 20), ('r-gone', 5, 99, NULL, '^user99@', NULL, NULL)),
  v AS (SELECT i.id, i.team_id, r.*, coalesce((severities IS NULL OR list_contains(severities, severity)) AND (pattern IS NULL OR regexp_matches(principal, pattern)) AND (min_risk IS NULL OR risk_score >= min_risk) AND (max_risk IS NULL OR risk_score <= max_risk), false) AS holds FROM v_incidents i, r)"""


def routes(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(ROUTES, "rule string, priority int, team int, severities array<string>, pattern string, min_risk int, max_risk int")


BOOK.on("route_explain", "v_incidents", f"WITH {DUCK_ROUTES} SELECT id, rule, holds FROM v")(lambda df: I.routing(df, routes(df)).select("id", "rule", "holds"))
BOOK.on("route_first_match", "v_incidents", f"WITH {DUCK_ROUTES} SELECT id, arg_min(rule, (priority, rule)) FILTER (WHERE holds) AS rule, arg_min(team, (priority, rule)) FILTER (WHERE holds) AS team FROM v GROUP BY id")(lambda df: I.first_route(df, routes(df)))


#: Rules over the facts of an incident's alerts: rule, priority, team, and one condition each but the last, which has several.
FACT_ROUTES = [
    ("f-tactic", 10, 1, {"tactics": ["exfiltration", "credential-access"], "min_risk": 95}), ("f-technique", 20, 2, {"techniques": ["T10?8", "t11*"], "max_risk": 60}), ("f-rule", 30, 3, {"rule_ids": ["AUTH-*"], "tenants": ["t0", "t9"]}),
    ("f-host", 40, 4, {"hostnames": ["web-[78]", "WEB-8", "db*"]}), ("f-ip", 50, 5, {"source_ips": ["10.0.0.1?"]}), ("f-scenario", 60, 6, {"scenarios": ["brute*"]}), ("f-who", 70, 7, {"principals": ["user1*@corp.example"], "severities": ["HIGH", "critical"]}),
]
FACTS = "incidents AS (SELECT incident_id AS id, min(tenant) AS tenant, max(risk_score) AS risk_score, min(principal) AS principal, CASE WHEN count(*) % 2 = 0 THEN 'brute-force' END AS scenario, CASE WHEN max(risk_score) >= 90 THEN 'high' ELSE 'low' END AS severity FROM v_alerts GROUP BY incident_id)"


def facts(alerts: DataFrame) -> DataFrame:
    made = alerts.groupBy(F.col("incident_id").alias("id")).agg(F.min("tenant").alias("tenant"), F.max("risk_score").alias("risk_score"), F.min("principal").alias("principal"), F.when(F.count(F.lit(1)) % 2 == 0, "brute-force").alias("scenario"))
    return I.incident_facts(made.withColumn("severity", F.when(F.col("risk_score") >= 90, "high").otherwise("low")), alerts)


@BOOK.over("route_by_facts", "v_alerts", oracle=f"""WITH {FACTS}, f AS (SELECT incident_id AS id, list(tactic) AS tactics, bool_or(technique GLOB 'T10?8' OR technique GLOB 'T11*') AS technique, bool_or(rule_id LIKE 'auth-%') AS rule_, bool_or(hostname IN ('web-8') OR hostname LIKE 'db%') AS host, bool_or(source_ip GLOB '10.0.0.1?') AS ip FROM v_alerts GROUP BY 1)
  SELECT id, CASE WHEN (list_contains(tactics, 'exfiltration') OR list_contains(tactics, 'credential-access')) AND risk_score >= 95 THEN 'f-tactic' WHEN technique AND risk_score <= 60 THEN 'f-technique' WHEN rule_ AND tenant IN ('t0', 't9') THEN 'f-rule' WHEN host THEN 'f-host' WHEN ip THEN 'f-ip' WHEN scenario LIKE 'brute%' THEN 'f-scenario' WHEN principal GLOB 'user1*@corp.example' AND severity IN ('high', 'critical') THEN 'f-who' END AS rule FROM incidents JOIN f USING (id)""")
def route_by_facts(alerts: DataFrame) -> DataFrame:
    """Incidents routed by tenant, tactic, technique, rule, host, address, scenario, principal, severity and risk."""
    lists = [*I.LISTED, *I.GLOBBED]
    kind = "rule string, priority int, team int, min_risk int, max_risk int, " + ", ".join(f"{n} array<string>" for n in lists)
    rows = [(r, p, t, m.get("min_risk"), m.get("max_risk"), *(m.get(n) for n in lists)) for r, p, t, m in FACT_ROUTES]
    return I.first_route(facts(alerts), alerts.sparkSession.createDataFrame(rows, kind)).select("id", "rule")


@BOOK.over("route_apply", "v_incidents", "v_teams", oracle=f"WITH {DUCK_ROUTES}, f AS (SELECT id, arg_min(rule, (priority, rule)) FILTER (WHERE holds) AS rule, arg_min(team, (priority, rule)) FILTER (WHERE holds) AS team FROM v GROUP BY id) SELECT f.id, coalesce(t.team, CASE WHEN i.severity <> 'informational' THEN 'team-0' END) AS queue, CASE WHEN t.team IS NOT NULL THEN f.rule WHEN i.severity <> 'informational' THEN 'default' ELSE 'unrouted' END AS placed_by FROM f JOIN v_incidents i USING (id) LEFT JOIN v_teams t ON t.team_id = f.team AND t.enabled")
def route_apply(incidents: DataFrame, teams: DataFrame) -> DataFrame:
    """The rule's team if it exists and works, else the default queue, else none."""
    routed = I.first_route(incidents, routes(incidents)).withColumnRenamed("team", "team_id").join(incidents.select("id", "severity"), "id")
    named = routed.join(teams.where("enabled").select("team_id", F.col("team").alias("own")), "team_id", "left")
    fallback = F.when(F.col("severity") != "informational", "team-0")
    return named.select("id", F.coalesce("own", fallback).alias("queue"), F.when(F.col("own").isNotNull(), F.col("rule")).when(fallback.isNotNull(), "default").otherwise("unrouted").alias("placed_by"))


# Cases

@BOOK.on("case_state", "v_actions", """SELECT incident_id, arg_max(CASE WHEN action = 'claimed' THEN actor ELSE '' END, (t, id)) FILTER (WHERE action IN ('claimed', 'unclaimed')) AS owner, arg_max(team_id, (t, id)) FILTER (WHERE action = 'transferred') AS team_id,
  arg_max(to_status, (t, id)) FILTER (WHERE action = 'transition') AS status, min(t) FILTER (WHERE action = 'claimed') AS acknowledged, count(*) AS version FROM v_actions GROUP BY incident_id""")
def case_state(df: DataFrame) -> DataFrame:
    """Current owner, team, status and first acknowledgement, folded from the action log."""
    last = F.struct("t", "id")
    when = lambda c, *a: F.when(F.col("action").isin(*a), c)
    return df.groupBy("incident_id").agg(
        F.max_by(F.when(F.col("action") == "claimed", F.col("actor")).otherwise(""), when(last, "claimed", "unclaimed")).alias("owner"),
        F.max_by("team_id", when(last, "transferred")).alias("team_id"),
        F.max_by("to_status", when(last, "transition")).alias("status"),
        F.min(when(F.col("t"), "claimed")).alias("acknowledged"),
        F.count(F.lit(1)).alias("version"),
    )


PAIRS = "p(from_status, to_status) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in I.TRANSITIONS.items() for b in to) + ")"


@BOOK.on("case_bad_transitions", "v_actions", f"WITH {PAIRS} SELECT id, from_status, to_status FROM v_actions a WHERE action = 'transition' AND NOT EXISTS (SELECT 1 FROM p WHERE p.from_status = a.from_status AND p.to_status = a.to_status)")
def bad_transitions(df: DataFrame) -> DataFrame:
    return df.where("action = 'transition'").join(F.broadcast(I.transition_table(df)), ["from_status", "to_status"], "left_anti").select("id", "from_status", "to_status")


@BOOK.on("case_allowed_next", "v_incidents", f"WITH {PAIRS} SELECT id, array_to_string(list_sort(list(p.to_status)), ',') AS allowed FROM v_incidents i JOIN p ON p.from_status = i.status GROUP BY id")
def allowed_next(df: DataFrame) -> DataFrame:
    to = I.transition_table(df).groupBy("from_status").agg(F.array_join(F.array_sort(F.collect_list("to_status")), ",").alias("allowed"))
    return df.join(F.broadcast(to), F.col("status") == F.col("from_status")).select("id", "allowed")


@BOOK.over("case_role_violations", "v_actions", "v_users", oracle="WITH least(to_status, rank) AS (VALUES ('closed', 2), ('contained', 1), ('investigating', 1), ('triaged', 1), ('waiting', 1), ('new', 2)) SELECT a.id, a.role, a.to_status FROM v_actions a JOIN least l USING (to_status) WHERE a.action = 'transition' AND CASE a.role WHEN 'viewer' THEN 0 WHEN 'analyst' THEN 1 ELSE 2 END < l.rank AND NOT EXISTS (SELECT 1 FROM v_users u WHERE u.email = a.actor AND u.role = 'lead' AND u.team_id = a.team_id)")
def role_violations(actions: DataFrame, users: DataFrame) -> DataFrame:
    need = F.create_map(*(F.lit(x) for s, r in I.LEAST_ROLE.items() for x in (s, I.ROLES.index(r))))
    below = actions.where("action = 'transition'").where(I.rank_of(F.col("role"), I.ROLES) < need[F.col("to_status")])
    leads = users.where("role = 'lead'").select(F.col("email").alias("actor"), "team_id")
    return below.join(leads, ["actor", "team_id"], "left_anti").select("id", "role", "to_status")


BOOK.on("case_closed_unclaimed", "v_incidents", "SELECT id, team_id FROM v_incidents WHERE status = 'closed' AND assignee IS NULL AND team_id < 25")(lambda df: df.where("status = 'closed' AND assignee IS NULL AND team_id < 25").select("id", "team_id"))


@BOOK.on("case_stale_writes", "v_actions", "SELECT id, expected_version::BIGINT AS expected, version FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY t, id) AS version FROM v_actions) WHERE expected_version <> version")
def stale_writes(df: DataFrame) -> DataFrame:
    version = F.row_number().over(Window.partitionBy("incident_id").orderBy("t", "id")).cast("long")
    return df.withColumn("version", version).where("expected_version <> version").select("id", F.col("expected_version").cast("long").alias("expected"), "version")


BOOK.on("case_wakeup_due", "v_incidents", f"SELECT id, waiting_until FROM v_incidents WHERE parked = 'waiting' AND status <> 'closed' AND waiting_until <= {NOW}")(lambda df: df.where(f"parked = 'waiting' AND {OPEN} AND waiting_until <= {NOW}").select("id", "waiting_until"))


@BOOK.on("resp_four_eyes", "v_actions", "WITH r AS (SELECT incident_id, arg_min(actor, (t, id)) AS requester FROM v_actions GROUP BY incident_id) SELECT a.id, CASE WHEN a.action = 'transferred' AND a.actor = r.requester THEN 'approved by requester' ELSE 'executed without approval' END AS problem FROM v_actions a JOIN r USING (incident_id) WHERE a.action = 'transferred' AND a.actor = r.requester OR a.action = 'transition' AND NOT EXISTS (SELECT 1 FROM v_actions b WHERE b.incident_id = a.incident_id AND b.action = 'transferred' AND b.t <= a.t)")
def four_eyes(df: DataFrame) -> DataFrame:
    """Approvals (transfers here) by the requester, and executions (transitions) that no approval precedes."""
    requester = df.groupBy("incident_id").agg(F.min_by("actor", F.struct("t", "id")).alias("requester"))
    approved = df.where("action = 'transferred'").groupBy("incident_id").agg(F.min("t").alias("approved"))
    seen = df.join(requester, "incident_id").join(approved, "incident_id", "left")
    own = F.expr("action = 'transferred' AND actor = requester")
    bare = F.expr("action = 'transition' AND (approved IS NULL OR approved > t)")
    return seen.where(own | bare).select("id", F.when(own, "approved by requester").otherwise("executed without approval").alias("problem"))


@BOOK.on("resp_suggest_target", "v_alerts", "SELECT incident_id, CASE incident_id % 3 WHEN 0 THEN min(principal) WHEN 1 THEN list_sort(list(DISTINCT source_ip))[1] ELSE list_sort(list(DISTINCT hostname))[1] END AS target FROM v_alerts GROUP BY incident_id")
def suggest_target(df: DataFrame) -> DataFrame:
    found = df.groupBy("incident_id").agg(F.min("principal").alias("account"), F.array_sort(F.collect_set("source_ip")).alias("ips"), F.array_sort(F.collect_set("hostname")).alias("hosts"))
    return found.select("incident_id", F.when(F.col("incident_id") % 3 == 0, F.col("account")).when(F.col("incident_id") % 3 == 1, F.element_at("ips", 1)).otherwise(F.element_at("hosts", 1)).alias("target"))


# Sorted lists and timelines

BOOK.on("top_event_search", "v_events", "SELECT event_id, t, count(*) OVER () AS total FROM v_events WHERE status_id = 2 ORDER BY t DESC, event_id LIMIT 50 OFFSET 100")(lambda df: df.where("status_id = 2").join(F.broadcast(df.where("status_id = 2").agg(F.count(F.lit(1)).alias("total"))), F.lit(True)).orderBy(F.desc("t"), "event_id").offset(100).limit(50).select("event_id", "t", "total"))
BOOK.on("top_alerts", "v_alerts", "SELECT id, risk_score FROM v_alerts WHERE NOT is_building_block AND status <> 'closed' ORDER BY risk_score DESC, t DESC, id LIMIT 100")(lambda df: df.where("NOT is_building_block AND status <> 'closed'").orderBy(F.desc("risk_score"), F.desc("t"), "id").limit(100).select("id", "risk_score"))
BOOK.on("top_incidents", "v_incidents", "SELECT id, risk_score, created FROM v_incidents WHERE status <> 'closed' AND severity IN ('critical', 'high') AND assignee IS NULL ORDER BY risk_score DESC, created, id LIMIT 100")(lambda df: df.where(f"{OPEN} AND severity IN ('critical', 'high') AND assignee IS NULL").orderBy(F.desc("risk_score"), "created", "id").limit(100).select("id", "risk_score", "created"))
BOOK.on("top_rules", "v_alerts", "SELECT rule_id, count(*) AS alerts, CAST(sum(occurrences) AS BIGINT) AS occurrences, max(risk_score) AS max_risk FROM v_alerts GROUP BY rule_id ORDER BY occurrences DESC, rule_id LIMIT 3")(lambda df: df.groupBy("rule_id").agg(F.count(F.lit(1)).alias("alerts"), F.sum("occurrences").alias("occurrences"), F.max("risk_score").alias("max_risk")).orderBy(F.desc("occurrences"), "rule_id").limit(3))

DUE = "CASE severity WHEN 'critical' THEN {0} WHEN 'high' THEN {1} WHEN 'medium' THEN {2} WHEN 'low' THEN {3} END"
ACK, RES = DUE.format(15, 60, 240, 480), DUE.format(240, 480, 1440, 4320)
CLOCK = "CASE WHEN {due} IS NULL THEN 'none' WHEN {done} <= {due} THEN 'met' WHEN coalesce({done}, {now}) > {due} THEN 'breached' WHEN {now} - created >= 0.75::DOUBLE * ({due} - created) THEN 'at_risk' ELSE 'ok' END"
DUES = f"d AS (SELECT *, created + ({ACK})::BIGINT * 60000000 AS ack_due, created + ({RES})::BIGINT * 60000000 AS res_due FROM v_incidents)"
CLOCKS = f"c AS (SELECT *, {CLOCK.format(due='ack_due', done='acknowledged', now=NOW)} AS ack_state, {CLOCK.format(due='res_due', done='closed', now=NOW)} AS res_state FROM d)"


def clocks(df: DataFrame) -> DataFrame:
    out = df.withColumn("ack_due", M.due(F.col("created"), F.col("severity"), 0)).withColumn("res_due", M.due(F.col("created"), F.col("severity"), 1))
    state = lambda due, done: M.clock(F.col("created"), F.col(due), F.col(done), F.lit(NOW))
    return out.withColumn("ack_state", state("ack_due", "acknowledged")).withColumn("res_state", state("res_due", "closed"))


BOOK.on("top_team_queue", "v_incidents", f"WITH {DUES}, {CLOCKS} SELECT id, created, res_state FROM c WHERE team_id = 3 AND status <> 'closed' ORDER BY created, id")(lambda df: clocks(df.where(f"team_id = 3 AND {OPEN}")).orderBy("created", "id").select("id", "created", "res_state"))


@BOOK.over("top_handover", "v_incidents", "v_actions", oracle="WITH l AS (SELECT incident_id, arg_max(action, (t, id)) AS last_action, arg_max(actor, (t, id)) AS last_actor FROM v_actions GROUP BY incident_id) SELECT i.id, l.last_action, l.last_actor FROM v_incidents i LEFT JOIN l ON l.incident_id = i.id WHERE i.status <> 'closed'")
def handover(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    last = actions.groupBy("incident_id").agg(F.max_by(F.struct("action", "actor"), F.struct("t", "id")).alias("last"))
    return incidents.where(OPEN).join(last, F.col("id") == F.col("incident_id"), "left").select("id", F.col("last.action").alias("last_action"), F.col("last.actor").alias("last_actor"))


@BOOK.on("set_timeline_events", "v_events", "SELECT DISTINCT event_id, t FROM v_events WHERE (principal = 'user8@corp.example' OR target_principal = 'user8@corp.example' OR source_ip = '203.0.113.20' OR hostname = 'db-prod-1') AND t BETWEEN 1704500000000000 AND 1705500000000000 ORDER BY t, event_id")
def timeline_events(df: DataFrame) -> DataFrame:
    """Union of the entities' probes, each event once, in time order."""
    own = df.where("t BETWEEN 1704500000000000 AND 1705500000000000")
    entities = [("principal", "user8@corp.example"), ("target_principal", "user8@corp.example"), ("source_ip", "203.0.113.20"), ("hostname", "db-prod-1")]
    probes = [own.where(F.col(c) == v).select("event_id", "t") for c, v in entities]
    out = probes[0]
    for p in probes[1:]:
        out = out.union(p)
    return out.dropDuplicates(["event_id"]).orderBy("t", "event_id")


@BOOK.over("set_incident_timeline", "v_alerts", "v_events", oracle="""WITH a AS (SELECT incident_id, principal, min(t) - 300000000 AS lo, max(t) + 300000000 AS hi FROM v_alerts GROUP BY incident_id, principal)
  SELECT incident_id, t, 'alert' AS kind, id AS ref FROM v_alerts UNION ALL SELECT a.incident_id, e.t, 'event', e.event_id FROM a JOIN v_events e ON e.principal = a.principal AND e.t BETWEEN a.lo AND a.hi AND e.k % 5 = a.incident_id % 100""")
def incident_timeline(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts and, within the padded span of an incident, its principal's events."""
    span = alerts.groupBy("incident_id", "principal").agg((F.min("t") - 300 * W.SECOND).alias("lo"), (F.max("t") + 300 * W.SECOND).alias("hi"))
    near = events.select("event_id", F.col("t").alias("at"), "principal", "k").join(span, "principal").where("at BETWEEN lo AND hi AND k % 5 = incident_id % 100")
    return alerts.select("incident_id", "t", F.lit("alert").alias("kind"), F.col("id").alias("ref")).unionByName(near.select("incident_id", F.col("at").alias("t"), F.lit("event").alias("kind"), F.col("event_id").alias("ref"))).orderBy("incident_id", "t", "kind", "ref")


@BOOK.over("set_audit_trail", "v_actions", "v_links", oracle="WITH e AS (SELECT 20 AS id UNION SELECT b FROM v_links WHERE a = 20 UNION SELECT a FROM v_links WHERE b = 20) SELECT id, t, action FROM v_actions WHERE incident_id IN (SELECT id FROM e) ORDER BY t DESC, id")
def audit_trail(actions: DataFrame, links: DataFrame) -> DataFrame:
    """Actions of an incident and of those linked to it, newest first."""
    one = actions.sparkSession.range(20, 21).select(F.col("id").alias("incident_id"))
    ids = one.union(links.where("a = 20").select("b")).union(links.where("b = 20").select("a")).distinct()
    return actions.join(ids, "incident_id", "left_semi").orderBy(F.desc("t"), "id").select("id", "t", "action")


@BOOK.on("top_attack_path", "v_alerts", "WITH o(tactic, ordinal, name) AS (VALUES " + ", ".join(f"('{s}', {i}, '{n}')" for i, (s, _, n) in enumerate(TACTICS)) + ") SELECT incident_id, string_agg(name, ' > ' ORDER BY ordinal) AS path FROM (SELECT DISTINCT incident_id, tactic FROM v_alerts) JOIN o USING (tactic) GROUP BY incident_id")
def attack_path(df: DataFrame) -> DataFrame:
    order = F.create_map(*(F.lit(x) for i, (s, _, n) in enumerate(TACTICS) for x in (s, i)))
    names = F.create_map(*(F.lit(x) for s, _, n in TACTICS for x in (s, n)))
    step = F.struct(F.coalesce(order[F.col("tactic")], F.lit(len(TACTICS))).alias("at"), F.coalesce(names[F.col("tactic")], F.col("tactic")).alias("name"))
    steps = F.sort_array(F.collect_set(step))
    return df.groupBy("incident_id").agg(F.array_join(F.transform(steps, lambda x: x["name"]), " > ").alias("path"))


BOOK.on("top_notifications", "v_alerts", "SELECT status, count(*) AS n, max(t) AS newest FROM v_alerts GROUP BY status ORDER BY newest DESC")(lambda df: df.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("newest")).orderBy(F.desc("newest")))

# SLA and SOC metrics

BOOK.on("sla_due", "v_incidents", f"WITH {DUES} SELECT id, ack_due, res_due FROM d")(lambda df: clocks(df).select("id", "ack_due", "res_due"))
BOOK.on("sla_clock", "v_incidents", f"WITH {DUES}, {CLOCKS} SELECT id, ack_state, res_state, (res_due - coalesce(closed, {NOW})) // 1000000 AS seconds_left FROM c WHERE res_due >= coalesce(closed, {NOW}) OR res_due IS NULL")(lambda df: clocks(df).where(f"res_due >= coalesce(closed, {NOW}) OR res_due IS NULL").select("id", "ack_state", "res_state", F.expr(f"(res_due - coalesce(closed, {NOW})) div 1000000").alias("seconds_left")))
RANKS = "list_position(['none', 'met', 'ok', 'at_risk', 'breached'], {0})"
BOOK.on("sla_headline", "v_incidents", f"WITH {DUES}, {CLOCKS} SELECT id, CASE WHEN {RANKS.format('ack_state')} >= {RANKS.format('res_state')} THEN ack_state ELSE res_state END AS headline FROM c")(lambda df: clocks(df).select("id", M.worse(F.col("ack_state"), F.col("res_state")).alias("headline")))
BREACHED = f"status <> 'closed' AND (acknowledged IS NULL AND ack_due < {NOW} OR res_due < {NOW})"
BOOK.on("sla_breaches", "v_incidents", f"WITH {DUES} SELECT id, risk_score FROM d WHERE {BREACHED} ORDER BY risk_score DESC, id")(lambda df: clocks(df).where(BREACHED).orderBy(F.desc("risk_score"), "id").select("id", "risk_score"))
BOOK.on("sla_escalations", "v_incidents", f"WITH {DUES} SELECT id, severity, CASE severity WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END AS raised FROM d WHERE {BREACHED} AND id % 13 <> 0 AND severity <> 'critical'")(lambda df: clocks(df).where(BREACHED).where("id % 13 <> 0 AND severity <> 'critical'").select("id", "severity", F.element_at(F.array(*map(F.lit, I.SEVERITY_ORDER)), (I.rank_of(F.col("severity"), I.SEVERITY_ORDER) + 2).cast("int")).alias("raised")))

STATS = "count(*) AS n, round(CAST(sum(s) AS DOUBLE) / count(*), 6) AS mean, median(s)::DOUBLE AS median, list_sort(list(s))[least(floor(count(*) * 0.9::DOUBLE), count(*) - 1)::BIGINT + 1] AS p90"


def _seconds(end: str, start: str):
    return lambda df: df.withColumn("s", F.expr(f"({end} - {start}) div 1000000")).where("s IS NOT NULL")


BOOK.on("soc_mttd", "v_incidents", f"SELECT {STATS} FROM (SELECT (created - first_seen) // 1000000 AS s FROM v_incidents) WHERE s >= 0")(lambda df: M.summarise(_seconds("created", "first_seen")(df), [], "s"))
BOOK.on("soc_mtta", "v_incidents", f"SELECT {STATS} FROM (SELECT (acknowledged - created) // 1000000 AS s FROM v_incidents) WHERE s >= 0")(lambda df: M.summarise(_seconds("acknowledged", "created")(df), [], "s"))
BOOK.on("soc_mttr", "v_incidents", f"SELECT disposition, {STATS} FROM (SELECT disposition, (closed - created) // 1000000 AS s FROM v_incidents) WHERE s >= 0 GROUP BY disposition UNION ALL SELECT 'all', {STATS} FROM (SELECT (closed - created) // 1000000 AS s FROM v_incidents) WHERE s >= 0")(lambda df: M.summarise(_seconds("closed", "created")(df), ["disposition"], "s").unionByName(M.summarise(_seconds("closed", "created")(df).withColumn("disposition", F.lit("all")), ["disposition"], "s")))
BOOK.on("soc_by_team", "v_incidents", f"SELECT team_id, {STATS} FROM (SELECT team_id, (acknowledged - created) // 1000000 AS s FROM v_incidents) WHERE s >= 0 GROUP BY team_id")(lambda df: M.summarise(_seconds("acknowledged", "created")(df), ["team_id"], "s"))
BOOK.on("soc_by_analyst", "v_incidents", f"SELECT assignee, {STATS} FROM (SELECT assignee, (closed - created) // 1000000 AS s FROM v_incidents WHERE assignee IS NOT NULL) WHERE s >= 0 GROUP BY assignee")(lambda df: M.summarise(_seconds("closed", "created")(df.where("assignee IS NOT NULL")), ["assignee"], "s"))


@BOOK.on("soc_sla_attainment", "v_incidents", f"WITH {DUES}, {CLOCKS}, u AS (SELECT 'acknowledge' AS clock, ack_state AS state FROM c UNION ALL SELECT 'resolve', res_state FROM c) SELECT clock, count(*) FILTER (WHERE state = 'met') AS met, count(*) FILTER (WHERE state = 'breached') AS breached, count(*) FILTER (WHERE state IN ('met', 'breached')) AS total, round(count(*) FILTER (WHERE state = 'met')::DOUBLE / count(*) FILTER (WHERE state IN ('met', 'breached')), 6) AS ratio FROM u GROUP BY clock")
def attainment(df: DataFrame) -> DataFrame:
    states = F.explode(F.map_from_arrays(F.array(F.lit("acknowledge"), F.lit("resolve")), F.array("ack_state", "res_state")))
    met, breached = F.count_if(F.col("value") == "met"), F.count_if(F.col("value") == "breached")
    return clocks(df).select(states).groupBy(F.col("key").alias("clock")).agg(met.alias("met"), breached.alias("breached"), (met + breached).alias("total"), F.round(met / (met + breached), 6).alias("ratio"))


@BOOK.on("soc_reopen_rate", "v_actions", "SELECT count(*) FILTER (WHERE from_status = 'closed' AND to_status <> 'closed') AS reopened, count(*) FILTER (WHERE to_status = 'closed' AND role <> 'viewer') AS closures, round(count(*) FILTER (WHERE from_status = 'closed' AND to_status <> 'closed')::DOUBLE / count(*) FILTER (WHERE to_status = 'closed' AND role <> 'viewer'), 6) AS rate FROM v_actions WHERE action = 'transition'")
def reopen_rate(df: DataFrame) -> DataFrame:
    reopened, closures = F.count_if(F.expr("from_status = 'closed' AND to_status <> 'closed'")), F.count_if(F.expr("to_status = 'closed' AND role <> 'viewer'"))
    return df.where("action = 'transition'").agg(reopened.alias("reopened"), closures.alias("closures"), F.round(reopened / closures, 6).alias("rate"))


@BOOK.over("soc_queue_age", "v_incidents", "v_teams", oracle=f"SELECT coalesce(t.team, 'unrouted') AS queue, count(*) AS open, count(*) FILTER (WHERE assignee IS NULL) AS unclaimed, ({NOW} - min(created) FILTER (WHERE assignee IS NULL)) // 1000000 AS oldest_seconds FROM v_incidents i LEFT JOIN v_teams t USING (team_id) WHERE status <> 'closed' GROUP BY 1 ORDER BY oldest_seconds DESC")
def queue_age(incidents: DataFrame, teams: DataFrame) -> DataFrame:
    named = incidents.where(OPEN).join(teams.select("team_id", "team"), "team_id", "left")
    found = named.groupBy(F.coalesce("team", F.lit("unrouted")).alias("queue")).agg(F.count(F.lit(1)).alias("open"), F.count_if(F.col("assignee").isNull()).alias("unclaimed"), F.min(F.when(F.col("assignee").isNull(), F.col("created"))).alias("oldest"))
    return found.select("queue", "open", "unclaimed", F.expr(f"({NOW} - oldest) div 1000000").alias("oldest_seconds")).orderBy(F.desc("oldest_seconds"))
