"""Security-shaped views over the given tables.

Each view is one SELECT in SQL that Spark and DuckDB share, but for a few functions that
are spelled per dialect. Spark reads it as a DataFrame, the oracles as a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Spelled per dialect: microseconds of a timestamp, the number k of a JSON text, whole division, a timestamp from microseconds.
DIALECTS = {
    "spark": {"us": "unix_micros(CAST({0} AS TIMESTAMP))", "k": "CAST(get_json_object({0}, '$.k') AS BIGINT)", "div": "({0} div {1})", "str": "CAST({0} AS STRING)", "arr": "array({0})"},
    "duckdb": {"us": "epoch_us({0})", "k": "CAST(json_extract_string({0}, '$.k') AS BIGINT)", "div": "({0} // {1})", "str": "CAST({0} AS VARCHAR)", "arr": "[{0}]"},
}

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_events": (("events",), """
SELECT event_id, @us(ts) AS t, user_id, event_type, value, @k(props) AS k,
  't' || @str(user_id % 3) AS tenant,
  CASE event_type WHEN 'purchase' THEN 3005 WHEN 'click' THEN 3001 WHEN 'view' THEN 6005 ELSE 3002 END AS class_uid,
  1 AS activity_id,
  CASE event_type WHEN 'error' THEN 2 ELSE 1 END AS status_id,
  CASE event_type WHEN 'purchase' THEN 4 WHEN 'click' THEN 4 WHEN 'error' THEN 2 ELSE 1 END AS severity_id,
  CASE WHEN user_id % 11 = 0 THEN 'svc-job' || @str(user_id) ELSE 'user' || @str(user_id) || '@corp.example' END AS principal,
  CASE WHEN event_type IN ('purchase', 'click') THEN 'user' || @str((user_id * 7) % 150) || '@corp.example' END AS target_principal,
  CASE WHEN user_id % 5 = 0 THEN '203.0.113.' || @str(user_id) WHEN user_id % 5 = 1 THEN '192.168.' || @str(@k(props)) || '.' || @str(user_id) ELSE '10.' || @str(user_id % 4) || '.' || @str(@k(props)) || '.' || @str(user_id) END AS source_ip,
  CASE WHEN user_id % 7 = 3 THEN 'db-prod-' || @str(user_id % 4) ELSE 'web-' || @str(user_id % 9) END AS hostname,
  's' || @str(user_id) || '-' || @str(@k(props) % 5) AS session_uid,
  CASE @k(props) % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'BR' ELSE 'JP' END AS country,
  CASE event_type WHEN 'error' THEN 'Logon' WHEN 'signup' THEN 'Logon' WHEN 'purchase' THEN 'AttachUserPolicy' WHEN 'click' THEN 'CreateAccessKey' ELSE 'GetObject' END AS operation,
  CASE event_type WHEN 'error' THEN 403 ELSE 200 END AS http_code,
  CASE WHEN event_type IN ('error', 'signup') THEN @k(props) % 2 = 0 END AS is_mfa,
  CASE WHEN @k(props) % 10 = 0 THEN NULL WHEN @k(props) % 3 = 0 THEN 'curl/8.' || @str(@k(props)) WHEN @k(props) % 3 = 1 THEN 'Mozilla/5.0 (X11; Linux)' ELSE 'aws-cli/2.' || @str(@k(props)) || ' Python' END AS user_agent,
  CASE WHEN user_id % 4 = 0 THEN @arr('admins', 'Ops') WHEN user_id % 4 = 1 THEN @arr('staff') WHEN user_id % 4 = 2 THEN @arr('Ops', 'staff', 'wheel') END AS groups,
  event_type || ' by user' || @str(user_id) || ' k=' || @str(@k(props)) AS message
FROM events"""),
    "v_incidents": (("orders",), """
SELECT o_orderkey AS id, 't' || @str(o_custkey % 3) AS tenant, o_custkey AS owner_id, o_custkey % 26 AS team_id,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'informational' END AS severity,
  CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'investigating' ELSE 'new' END AS status,
  CAST(floor(o_totalprice / 5000) AS BIGINT) AS risk_score,
  @us(o_orderdate) + o_orderkey * 1000000 AS created, @us(o_orderdate) + o_orderkey * 1000000 - (o_orderkey % 240 - 5) * 60000000 AS first_seen,
  CASE WHEN o_orderkey % 4 <> 3 THEN @us(o_orderdate) + o_orderkey * 1000000 + (o_orderkey % 300) * 60000000 END AS acknowledged,
  CASE WHEN o_orderstatus = 'F' THEN @us(o_orderdate) + o_orderkey * 1000000 + (300 + o_orderkey % 2880) * 60000000 END AS closed,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'user' || @str(o_custkey % 150) || '@corp.example' END AS assignee,
  CASE WHEN o_orderkey % 4 <> 3 THEN TRUE ELSE FALSE END AS claimed,
  CASE o_orderkey % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' ELSE 'benign' END AS disposition,
  CASE o_orderkey % 6 WHEN 0 THEN 'waiting' ELSE '' END AS parked,
  CASE WHEN o_orderkey % 6 = 0 THEN @us(o_orderdate) + o_orderkey * 1000000 + (o_orderkey % 50) * 3600000000 END AS waiting_until,
  'user' || @str(o_custkey % 150) || '@corp.example' AS principal, 'scenario-' || @str(o_custkey % 5) AS scenario
FROM orders"""),
    "v_alerts": (("events",), """
SELECT event_id AS id, 't' || @str(user_id % 3) AS tenant, @us(ts) AS t,
  CASE event_type WHEN 'error' THEN 'auth-failures' WHEN 'signup' THEN 'auth-success' WHEN 'purchase' THEN 'role-change' WHEN 'click' THEN 'key-created' ELSE 'data-read' END AS rule_id,
  CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'high' WHEN 'error' THEN 'medium' ELSE 'low' END AS level,
  CASE event_type WHEN 'signup' THEN TRUE ELSE FALSE END AS is_building_block,
  CASE @k(props) % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'correlated' WHEN 2 THEN 'suppressed' ELSE 'closed' END AS status,
  'user' || @str(user_id) || '@corp.example' AS principal, '10.0.0.' || @str(user_id) AS source_ip, 'web-' || @str(user_id % 9) AS hostname,
  CASE @k(props) % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'BR' ELSE 'JP' END AS country,
  CAST(20 + (event_id * 37 + @k(props)) % 80 AS BIGINT) AS risk_score, 1 + @k(props) % 4 AS occurrences,
  CASE event_type WHEN 'error' THEN 'credential-access' WHEN 'signup' THEN 'initial-access' WHEN 'purchase' THEN 'privilege-escalation' WHEN 'click' THEN 'persistence' ELSE 'collection' END AS tactic,
  CASE event_type WHEN 'error' THEN 'T1110' WHEN 'signup' THEN 'T1078' WHEN 'purchase' THEN 'T1098' WHEN 'click' THEN 'T1136' ELSE 'T1530' END AS technique,
  user_id * 100 + @k(props) % 5 AS incident_id
FROM events"""),
    "v_actions": (("orders",), """
SELECT o_orderkey * 10 + n.n AS id, o_orderkey AS incident_id, 't' || @str(o_custkey % 3) AS tenant,
  @us(o_orderdate) + o_orderkey * 1000000 + n.n * (o_orderkey % 17 + 1) * 60000000 AS t,
  CASE (o_orderkey + n.n) % 6 WHEN 0 THEN 'claimed' WHEN 1 THEN 'transferred' WHEN 2 THEN 'transition' WHEN 3 THEN 'unclaimed' WHEN 4 THEN 'transition' ELSE 'note' END AS action,
  'user' || @str((o_custkey + n.n) % 150) || '@corp.example' AS actor,
  CASE (o_custkey + n.n) % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'analyst' ELSE 'lead' END AS role,
  CASE (o_orderkey + n.n) % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'triaged' WHEN 2 THEN 'investigating' WHEN 3 THEN 'contained' ELSE 'closed' END AS from_status,
  CASE (o_orderkey * 3 + n.n * 2) % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'triaged' WHEN 2 THEN 'investigating' WHEN 3 THEN 'contained' ELSE 'closed' END AS to_status,
  (o_custkey + n.n) % 25 AS team_id, CASE WHEN o_orderkey % 7 = 0 THEN n.n + 1 ELSE n.n END AS expected_version
FROM orders CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) n"""),
    "v_components": (("part", "supplier"), """
SELECT s_suppkey AS app_id, 'app-' || @str(s_suppkey) AS application, 't' || @str(s_suppkey % 3) AS tenant,
  CASE WHEN s_suppkey % 3 = 0 THEN 'critical' WHEN s_suppkey % 3 = 1 THEN 'high' ELSE 'low' END AS criticality,
  p_partkey AS part_id, 'lib-' || @str(p_partkey % (7 + @div((SELECT count(*) FROM part), 20))) AS package,
  CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'maven' END AS ecosystem,
  @str(@div(p_size, 10)) || '.' || @str(p_size % 10) || '.' || @str(p_partkey % 12) || CASE WHEN p_partkey % 19 = 0 THEN '-rc1' WHEN p_partkey % 23 = 0 THEN '-beta.2' ELSE '' END AS version,
  p_partkey % 4 = 0 AS direct, 1 + p_partkey % 2 AS revision
FROM part CROSS JOIN (SELECT count(*) AS n FROM supplier) apps JOIN supplier ON s_suppkey = p_partkey % n"""),
    "v_advisories": (("part",), """
SELECT *, CASE form WHEN 0 THEN NULL WHEN 1 THEN 'any' WHEN 2 THEN '^' || low WHEN 3 THEN '~>' || low WHEN 4 THEN ' ' WHEN 5 THEN '>=' || low || ', !=' || high || ' <=' || high ELSE '>=' || low || ' <' || high END AS affected
FROM (SELECT 'VULN-' || @str(p_partkey) AS vuln_id, 'lib-' || @str(p_partkey % (7 + @div((SELECT count(*) FROM part), 20))) AS package,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'npm' WHEN p_partkey % 3 = 1 THEN 'pypi' ELSE 'maven' END AS ecosystem,
  p_partkey % 13 AS form, @str(p_size % 3) || '.' || @str(p_partkey % 10) || '.0' AS low, @str(p_size % 3 + 2) || '.' || @str(p_partkey % 7) || '.5' AS high,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 11 = 1 THEN '' ELSE @str(p_size % 3 + 2) || '.' || @str(p_partkey % 7) || '.5' END AS fixed,
  CASE p_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
FROM part) a"""),
    "v_notes": (("conversations",), """
SELECT conv_id * 100 + turn AS id, conv_id AS incident_id, 't' || @str(conv_id % 3) AS tenant, turn AS t,
  CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN conv_id * 100 + turn - 1 ELSE conv_id * 100 + turn + 90000000 END AS parent_id,
  'user' || @str(conv_id % 150) || '@corp.example' AS author,
  'Hello @user' || @str(conv_id % 60) || ' see mail bob@corp.example and @User' || @str((conv_id + turn) % 200) || '@corp.example. cc @ghost' || @str(turn) || ', ' || coalesce(text, '') AS body
FROM conversations"""),
    "v_users": (("customer",), """
SELECT c_custkey AS user_id, 'user' || @str(c_custkey % 150) || CASE WHEN c_custkey < 150 THEN '@corp.example' ELSE '@other' || @str(@div(c_custkey, 150)) || '.example' END AS email,
  CASE c_custkey % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'analyst' ELSE 'lead' END AS role, c_custkey % (1 + @div((SELECT count(*) FROM customer), 30)) AS team_id
FROM customer"""),
    "v_teams": (("nation",), "SELECT CAST(n_nationkey AS BIGINT) AS team_id, 'team-' || @str(n_nationkey) AS team, n_nationkey % 4 <> 1 AS enabled FROM nation"),
    "v_links": (("orders",), """
SELECT o_orderkey AS a, (o_orderkey * 31 + o_custkey) % (SELECT count(*) FROM orders) AS b,
  CASE o_orderkey % 4 WHEN 0 THEN 'related' WHEN 1 THEN 'duplicate_of' WHEN 2 THEN 'child_of' ELSE 'related' END AS kind, @us(o_orderdate) AS t
FROM orders"""),
}


def text(view: str, dialect: str) -> str:
    """The view's SELECT in a dialect."""
    sql, forms = VIEWS[view][1], DIALECTS[dialect]
    call = re.compile(r"@(\w+)\(")
    while m := call.search(sql):
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        inside = sql[m.end() : at - 1]
        args = [inside] if m[1] in ("arr",) else _split(inside)
        sql = sql[: m.start()] + forms[m[1]].format(*args) + sql[at:]
    return sql.strip()


def _split(inside: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(inside):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(inside[last:i])
            last = i + 1
    return [*parts, inside[last:]]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, _ = VIEWS[name]
    sql = text(name, "spark")
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_views(body: str) -> str:
    """A DuckDB query with the views that it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body) and f"{v} AS (SELECT * FROM (" not in body]
    clauses = ",\n".join(f"{v} AS (SELECT * FROM ({text(v, 'duckdb')}))" for v in used)
    body = body.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if not used:
        return body
    return f"WITH {m[1] or ''}{clauses},\n{body[m.end():]}" if m else f"WITH {clauses}\n{body}"
