"""Normalization over raw records written from the event view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.functions.times import parse_time
from secflow.operators import chain, detect
from secflow.operators import events as E
from secflow.operators import normalize as N
from secflow.plans import detection_queries
from secflow.plans.base import Book
from secflow.sources.tables import written

BOOK = Book()
S = F.col
WHO_SQL = "'user' || user_id"
FIELDS = ("class_uid", "activity_id", "status_id", "severity_id", "actor", "target", "ip", "port", "is_mfa", "group_name")


def who() -> Column:
    return F.concat(F.lit("user"), F.col("user_id").cast("string"))


def port() -> Column:
    return (1024 + F.col("event_id") % 60000).cast("string")


def opened(df: DataFrame, event: Column, *names: str) -> DataFrame:
    return df.withColumn("e", event).select("event_id", *(F.col(f"e.{n}").alias(n) for n in names))


def line(df: DataFrame, program: str, message: Column) -> Column:
    """A syslog line of the event."""
    return F.concat(F.date_format(F.timestamp_micros("t"), "MMM dd HH:mm:ss"), F.lit(" "), F.col("hostname"), F.lit(f" {program}["), F.col("event_id").cast("string"), F.lit("]: "), message)


def sshd_text() -> Column:
    return F.when(S("k") % 5 == 0, F.concat(F.lit("Accepted publickey for "), who(), F.lit(" from "), "source_ip", F.lit(" port "), port(), F.lit(" ssh2"))).when(S("k") % 5 == 1, F.concat(F.lit("Failed password for invalid user "), who(), F.lit(" from "), "source_ip", F.lit(" port "), port(), F.lit(" ssh2"))).when(S("k") % 5 == 2, F.concat(F.lit("Invalid user "), who(), F.lit(" from "), "source_ip")).when(S("k") % 5 == 3, F.concat(F.lit("Disconnected from user "), who(), F.lit(" "), "source_ip", F.lit(" port 1"))).otherwise(F.concat(F.lit("pam_unix(sshd:session): session closed for user "), who()))


def sudo_text() -> Column:
    return F.when(S("k") % 3 == 0, F.concat(who(), F.lit(" : TTY=pts/0 ; PWD=/home ; USER="), F.when(S("k") % 2 == 0, "root").otherwise("deploy"), F.lit(" ; COMMAND=/bin/ls -l"))).when(S("k") % 3 == 1, F.concat(F.lit("pam_unix(sudo:session): session opened for user root(uid=0) by "), who(), F.lit("(uid=1000)"))).otherwise(F.concat(who(), F.lit(" : 3 incorrect password attempts ; TTY=pts/1")))


def shadow_text() -> Column:
    return F.when(S("k") % 4 == 0, F.concat(F.lit("new user: name="), who(), F.lit(", UID=1001, GID=1001, home=/home"))).when(S("k") % 4 == 1, F.concat(F.lit("add '"), who(), F.lit("' to group '"), F.when(S("k") % 8 == 1, "sudo").otherwise("games"), F.lit("'"))).when(S("k") % 4 == 2, F.concat(F.lit("delete user '"), who(), F.lit("'"))).otherwise(F.concat(F.lit("pam_unix: password changed for "), who()))



BOOK.on("norm_syslog", "v_events", "SELECT event_id, hostname AS host, 'sshd' AS program, event_id::INT AS pid, strftime(make_timestamp(t), '%b %d %H:%M:%S') AS \"timestamp\", 'hello: ' || principal AS message FROM v_events")(lambda df: df.withColumn("s", N.syslog(line(df, "sshd", F.concat(F.lit("hello: "), "principal")))).select("event_id", "s.host", "s.program", "s.pid", "s.timestamp", "s.message"))
BOOK.on("norm_sshd", "v_events", f"""SELECT event_id, 3002 AS class_uid, CASE WHEN k % 5 >= 3 THEN 2 ELSE 1 END AS activity_id, CASE WHEN k % 5 IN (1, 2) THEN 2 ELSE 1 END AS status_id, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS severity_id, {WHO_SQL} AS actor,
  CASE WHEN k % 5 < 4 THEN source_ip END AS ip, CASE WHEN k % 5 < 2 THEN (1024 + event_id % 60000)::INT END AS port, CASE WHEN k % 5 = 0 THEN true END AS is_mfa FROM v_events""")(lambda df: opened(df, N.sshd(sshd_text()), "class_uid", "activity_id", "status_id", "severity_id", "actor", "ip", "port", "is_mfa"))
BOOK.on("norm_sudo", "v_events", f"""SELECT event_id, CASE WHEN k % 3 = 0 THEN 1007 ELSE 3003 END AS class_uid, CASE WHEN k % 3 = 2 THEN 2 ELSE 1 END AS status_id, CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 1 ELSE 3 END AS severity_id, {WHO_SQL} AS actor,
  CASE WHEN k % 3 = 1 OR k % 6 = 0 THEN 'root' WHEN k % 3 = 0 THEN 'deploy' END AS target, CASE WHEN k % 3 = 0 THEN '/bin/ls -l' END AS command FROM v_events""")(lambda df: opened(df, N.sudo(sudo_text()), "class_uid", "status_id", "severity_id", "actor", "target", "command"))
BOOK.on("norm_shadow_utils", "v_events", f"""SELECT event_id, CASE WHEN k % 4 = 1 THEN 3006 ELSE 3001 END AS class_uid, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 3 END AS activity_id, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN CASE WHEN k % 8 = 1 THEN 4 ELSE 2 END WHEN 2 THEN 3 ELSE 0 END AS severity_id,
  CASE WHEN k % 4 = 3 THEN {WHO_SQL} ELSE 'root' END AS actor, {WHO_SQL} AS target, CASE WHEN k % 8 = 1 THEN 'sudo' WHEN k % 4 = 1 THEN 'games' END AS group_name FROM v_events""")(lambda df: opened(df, N.shadow_utils(shadow_text(), F.lit(None).cast("string")), "class_uid", "activity_id", "severity_id", "actor", "target", "group_name"))


@BOOK.on("norm_auditd", "v_events", "SELECT event_id, CASE WHEN k % 2 = 0 THEN 1007 ELSE 1001 END AS class_uid, CASE WHEN k % 6 = 0 THEN 2 ELSE 1 END AS status_id, CASE WHEN k % 2 = 0 THEN 0 WHEN k % 3 = 0 THEN 3 ELSE 1 END AS severity_id, principal AS actor, CASE WHEN k % 2 = 0 THEN '/bin/cat' WHEN k % 3 = 0 THEN '/etc/shadow' ELSE '/var/log/' || hostname END AS path FROM v_events")
def audit(df: DataFrame) -> DataFrame:
    launch = F.struct(F.lit("execve").alias("audit_type"), F.col("principal").alias("auid_name"), F.lit("/bin/cat").alias("exe"), F.when(F.col("k") % 6 == 0, "no").otherwise("yes").alias("success"))
    touch = F.struct(F.lit("PATH").alias("type"), F.col("principal").alias("user"), F.when(F.col("k") % 3 == 0, "/etc/shadow").otherwise(F.concat(F.lit("/var/log/"), "hostname")).alias("path"))
    payload = F.when(F.col("k") % 2 == 0, F.to_json(launch)).otherwise(F.to_json(touch))
    return opened(df, N.auditd(payload, F.col("message")), "class_uid", "status_id", "severity_id", "actor", "path")


def cloud_payload(df: DataFrame) -> DataFrame:
    name = F.when(F.col("event_type").isin("error", "signup"), "ConsoleLogin").when(F.col("k") % 10 == 9, "DescribeThings").when(F.col("k") % 10 == 8, "UpdateThing").otherwise(F.col("operation"))
    identity = F.struct(F.when(F.col("k") % 7 == 0, "AssumedRole").otherwise("IAMUser").alias("type"), F.when(F.col("k") % 3 == 0, F.col("principal")).alias("userName"), F.concat(F.lit("arn:aws:iam::1:user/"), "principal").alias("arn"))
    request = F.struct(F.col("target_principal").alias("userName"), F.when(F.col("event_type") == "view", F.concat(F.lit("bucket-"), "hostname")).alias("bucketName"))
    response = F.struct(F.when(F.col("event_type") == "error", "Failure").alias("ConsoleLogin"), F.when(F.col("event_type") == "click", F.struct(F.concat(F.lit("AKIA"), F.col("event_id").cast("string")).alias("accessKeyId"))).alias("accessKey"))
    extra = F.struct(F.when(F.col("is_mfa"), "Yes").otherwise("No").alias("MFAUsed"))
    listed = F.when(F.col("k") % 4 == 0, F.array(F.struct(F.concat(F.lit("arn:aws:iam::1:role/"), "hostname").alias("ARN"), F.lit("AWS::IAM::Role").alias("type"))))
    body = F.struct(name.alias("eventName"), identity.alias("userIdentity"), request.alias("requestParameters"), response.alias("responseElements"), extra.alias("additionalEventData"), listed.alias("resources"), F.col("source_ip").alias("sourceIPAddress"), F.when(F.col("http_code") == 403, "AccessDenied").alias("errorCode"))
    return df.withColumn("payload", F.to_json(body))


CLOUD_KIND = "CASE WHEN event_type IN ('error', 'signup') THEN {0} WHEN k % 10 = 9 THEN {1} WHEN k % 10 = 8 THEN {2} WHEN event_type = 'purchase' THEN {3} WHEN event_type = 'click' THEN {4} ELSE {5} END"
BOOK.on("norm_cloudtrail", "v_events", f"""SELECT event_id, {CLOUD_KIND.format(3002, 6003, 6003, 3005, 3001, 6005)} AS class_uid, {CLOUD_KIND.format(1, 2, 3, 1, 1, 1)} AS activity_id, CASE WHEN event_type = 'error' THEN 2 ELSE {CLOUD_KIND.format(1, 1, 2, 4, 4, 1)} END AS severity_id,
  CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status_id, principal AS actor, target_principal AS target, source_ip AS ip, CASE WHEN event_type IN ('error', 'signup') THEN CASE WHEN k % 7 = 0 THEN 'SAML' ELSE 'AWS Console' END END AS logon_type, coalesce(is_mfa, false) AS is_mfa FROM v_events""")(lambda df: opened(cloud_payload(df), N.cloudtrail(F.col("payload")), "class_uid", "activity_id", "severity_id", "status_id", "actor", "target", "ip", "logon_type", "is_mfa"))
BOOK.on("norm_cloudtrail_resources", "v_events", """SELECT event_id, concat_ws(';', CASE WHEN k % 4 = 0 THEN hostname || ':' || CASE WHEN contains(hostname, 'prod') THEN 'critical' ELSE '-' END END,
  CASE WHEN event_type = 'view' THEN 'bucket-' || hostname || ':' || CASE WHEN contains(hostname, 'prod') THEN 'critical' ELSE 'medium' END END, CASE WHEN event_type = 'click' THEN 'AKIA' || event_id || ':high' END) AS resources FROM v_events""")(
    lambda df: cloud_payload(df).select("event_id", F.array_join(F.transform(N.cloud_resources(F.col("payload")), lambda r: F.concat(r["name"], F.lit(":"), F.coalesce(r["criticality"], F.lit("-")))), ";").alias("resources"))
)


@BOOK.on("norm_okta", "v_events", "SELECT event_id, CASE k % 3 WHEN 0 THEN 3002 WHEN 1 THEN 3006 ELSE 3004 END AS class_uid, CASE WHEN status_id = 2 THEN greatest(2, CASE k % 3 WHEN 1 THEN 3 ELSE 1 END) ELSE CASE k % 3 WHEN 1 THEN 3 ELSE 1 END END AS severity_id, status_id, principal AS actor, CASE WHEN k % 2 = 0 THEN 'target@corp.example' END AS target, 'staff' AS group_name, source_ip AS ip, k % 5 = 0 AS is_mfa FROM v_events")
def okta(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("k") % 3 == 0, "user.session.start").when(F.col("k") % 3 == 1, "group.user_membership.add").otherwise("policy.evaluate")
    target = F.array(F.struct(F.lit("UserGroup").alias("type"), F.lit(None).cast("string").alias("alternateId"), F.lit("staff").alias("displayName")), F.struct(F.when(F.col("k") % 2 == 0, "User").otherwise("App").alias("type"), F.lit("target@corp.example").alias("alternateId"), F.lit("T").alias("displayName")))
    body = F.struct(kind.alias("eventType"), F.struct(F.when(F.col("status_id") == 2, "FAILURE").otherwise("SUCCESS").alias("result")).alias("outcome"), F.struct(F.col("principal").alias("alternateId")).alias("actor"), F.struct(F.col("source_ip").alias("ipAddress")).alias("client"), target.alias("target"), F.struct(F.when(F.col("k") % 5 == 0, "OTP").alias("credentialType")).alias("authenticationContext"))
    return opened(df.withColumn("payload", F.to_json(body)), N.identity_log(F.col("payload")), "class_uid", "severity_id", "status_id", "actor", "target", "group_name", "ip", "is_mfa")


@BOOK.on("norm_webapp", "v_events", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 3005 WHEN event_type IN ('error', 'signup') THEN 3002 WHEN event_type = 'click' THEN 3001 ELSE 6005 END AS class_uid, status_id, principal AS actor, target_principal AS target, CASE WHEN k % 2 = 0 THEN 'Admin' ELSE 'User' END AS target_type, session_uid AS session FROM v_events")
def webapp(df: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type") == "error", F.when(F.col("k") % 2 == 0, "login_failed").otherwise("login")).when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "purchase", "role_change").when(F.col("event_type") == "click", "api_key_created").otherwise("data_access")
    body = F.struct(action.alias("action"), F.col("principal").alias("user"), F.col("target_principal").alias("target_user"), F.when(F.col("k") % 2 == 0, "Owner").otherwise("member").alias("new_role"), F.col("session_uid").alias("session_id"), F.col("http_code").alias("status_code"))
    return opened(df.withColumn("payload", F.to_json(body)), N.web_app(F.col("payload")), "class_uid", "status_id", "actor", "target", "target_type", "session")


BOOK.on("norm_action_lookup", "v_events", f"SELECT event_id, {CLOUD_KIND.format(3002, 6003, 6003, 3005, 3001, 6005)} AS class_uid, {CLOUD_KIND.format(1, 2, 3, 1, 1, 1)} AS activity_id, {CLOUD_KIND.format(1, 1, 2, 4, 4, 1)} AS severity_id FROM v_events")(lambda df: opened(cloud_payload(df), N.cloud_class(F.get_json_object("payload", "$.eventName")), "class_uid", "activity_id", "severity_id"))


def raw_records(df: DataFrame) -> DataFrame:
    """Envelopes of all sources, some of them unknown or broken."""
    cloud = cloud_payload(df)
    source = F.when(F.col("k") % 6 == 0, "linux.sshd").when(F.col("k") % 6 == 1, "aws.cloudtrail").when(F.col("k") % 6 == 2, "app.audit").when(F.col("k") % 6 == 3, "linux.sudo").when(F.col("k") % 6 == 4, "linux.sshd").otherwise("unknown.x")
    raw = F.when(F.col("k") % 6 == 0, line(df, "sshd", sshd_text())).when(F.col("k") % 6 == 3, line(df, "sudo", sudo_text())).when(F.col("k") % 6 == 4, F.lit("broken line"))
    payload = F.when(F.col("k") % 6 == 1, F.col("payload")).when(F.col("k") % 6 == 2, F.to_json(F.struct(F.lit("login").alias("action"), F.col("principal").alias("user"))))
    return cloud.select("event_id", "t", source.alias("source"), "tenant", payload.alias("payload"), raw.alias("raw"), F.timestamp_micros("t").alias("received_at"))


BOOK.on("norm_dispatch", "v_events", "SELECT event_id, CASE k % 6 WHEN 0 THEN 'linux' WHEN 1 THEN 'aws.cloudtrail' WHEN 2 THEN 'app' WHEN 3 THEN 'linux' WHEN 4 THEN 'linux' END AS mapper FROM v_events")(lambda df: N.normalize(raw_records(df)).select("event_id", "mapper"))
BOOK.on("norm_split", "v_events", "SELECT CASE k % 6 WHEN 5 THEN 'no mapper for source' WHEN 4 THEN 'unrecognized record' END AS error, count(*) AS n FROM v_events GROUP BY 1")(lambda df: N.normalize(raw_records(df)).groupBy("error").agg(F.count(F.lit(1)).alias("n")))
BOOK.on("udf_mapper_registry", "v_events", "SELECT event_id, 6003 AS class_uid, principal AS actor FROM v_events WHERE k % 6 = 5")(lambda df: registered(df))


def registered(df: DataFrame) -> DataFrame:
    """A source of one's own: a function from columns to the mapped struct."""
    own = {"unknown": lambda payload, raw: N.made(class_uid=N.API, activity_id=1, actor=F.col("principal"))}
    raw = raw_records(df).join(df.select("event_id", "principal"), "event_id").where("source = 'unknown.x'")
    return N.normalize(raw, own).select("event_id", "event.class_uid", "event.actor")


BOOK.on("norm_labels", "v_events", "SELECT event_id, class_uid // 1000 AS category_uid, class_uid * 100 + activity_id AS type_uid, CASE class_uid WHEN 3001 THEN 'Account Change' WHEN 3002 THEN 'Authentication' WHEN 3005 THEN 'User Access Management' ELSE 'Datastore Activity' END AS class_name, CASE status_id WHEN 1 THEN 'Success' ELSE 'Failure' END AS status, CASE severity_id WHEN 1 THEN 'Informational' WHEN 2 THEN 'Low' ELSE 'High' END AS severity FROM v_events")(
    lambda df: df.select("event_id", *(c.alias(n) for n, c in N.labels(*map(F.col, ("class_uid", "activity_id", "status_id", "severity_id"))).items()))
)


@BOOK.on("norm_parse_time", "v_events", "SELECT event_id, CASE WHEN k % 7 IN (2, 3) THEN t WHEN k % 7 = 6 THEN NULL WHEN k % 7 = 1 THEN t // 1000 * 1000 ELSE t // 1000000 * 1000000 END AS parsed FROM v_events")
def parse(df: DataFrame) -> DataFrame:
    at, kind = F.timestamp_micros("t"), F.col("k") % 7
    text = (
        F.when(kind == 0, F.expr("CAST(t div 1000000 AS STRING)")).when(kind == 1, F.expr("CAST(t div 1000 AS STRING)")).when(kind == 2, F.col("t").cast("string")).when(kind == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == 4, F.date_format(at, "MMM  d HH:mm:ss")).when(kind == 5, F.date_format(at, "dd/MMM/yyyy:HH:mm:ss '+0000'")).otherwise("not a time")
    )
    return df.select("event_id", F.unix_micros(parse_time(text, at)).alias("parsed"))


KEY_SQL = "sha256(concat_ws('|', tenant, class_uid::VARCHAR, activity_id::VARCHAR, strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.%f+00:00'), coalesce(principal, 'None'), coalesce(target_principal, 'None'), coalesce(source_ip, 'None'), coalesce(hostname, 'None'), status_id::VARCHAR, operation, '', message))"
BOOK.on("norm_dedup_key", "v_events", f"SELECT event_id, {KEY_SQL} AS dedup_key FROM v_events")(lambda df: df.select("event_id", N.content_key(F.col("tenant"), F.col("class_uid"), F.col("activity_id"), F.timestamp_micros("t"), F.col("principal"), F.col("target_principal"), F.col("source_ip"), F.col("hostname"), F.col("status_id"), F.col("operation"), F.lit(None).cast("string"), F.col("message")).alias("dedup_key")))
BOOK.on("norm_record_key", "v_events", "SELECT event_id, sha256(tenant || '|linux|' || coalesce(user_agent, '')) AS record_key FROM v_events")(lambda df: df.select("event_id", N.record_key(F.col("tenant"), F.lit("linux"), F.col("user_agent")).alias("record_key")))
BOOK.on("norm_entities", "v_events", "SELECT event_id, CASE WHEN k % 4 = 0 THEN message ELSE principal END AS principal, coalesce(target_principal, 'none') AS target, status_id = 2 AS is_failure FROM v_events")(lambda df: df.select("event_id", N.first_known(F.when(F.col("k") % 4 == 0, "").otherwise(F.col("principal")), F.col("message")).alias("principal"), N.first_known(F.col("target_principal"), F.lit("none")).alias("target"), (F.col("status_id") == 2).alias("is_failure")))


def app_records(df: DataFrame) -> DataFrame:
    """Every event as the record that an application would have logged."""
    action = F.when(F.col("event_type") == "error", "login_failed").when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "purchase", "role_change").when(F.col("event_type") == "click", "api_key_created").otherwise("data_access")
    at = F.timestamp_micros("t")
    payload = F.struct(
        action.alias("action"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("principal").alias("user"), F.col("target_principal").alias("target_user"), F.col("source_ip").alias("ip"), F.col("hostname").alias("host"),
        F.col("session_uid").alias("session_id"), "operation", "user_agent", F.col("http_code").alias("status_code"), F.col("is_mfa").alias("mfa_used"), "groups", "message",
    )
    return df.select("event_id", F.lit("app.audit").alias("source"), "tenant", F.to_json(payload).alias("payload"), F.lit(None).cast("string").alias("raw"), at.alias("received_at"), F.lit("edge-1").alias("collector"))


def events_of(df: DataFrame) -> DataFrame:
    """The view's events, read from records, in their nested form."""
    return E.check_schema(E.nested(N.normalize(app_records(df))))


ISO = "strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.%f{0}')"
NESTED_KEY = "sha256(concat_ws('|', tenant, class_uid::VARCHAR, activity_id::VARCHAR, " + ISO.format("+00:00") + ", principal, coalesce(target_principal, 'None'), source_ip, hostname, status_id::VARCHAR, operation, '', message))"
MAIL = "CASE WHEN contains({0}, '@') THEN {0} END"
DOCUMENT = f"""json_merge_patch('{{}}', to_json({{
  class_uid: class_uid, class_name: CASE class_uid WHEN 3001 THEN 'Account Change' WHEN 3002 THEN 'Authentication' WHEN 3005 THEN 'User Access Management' ELSE 'Datastore Activity' END, category_uid: class_uid // 1000, activity_id: activity_id, type_uid: class_uid * 100 + activity_id,
  "time": {ISO.format('+00:00')}, status_id: status_id, status: CASE status_id WHEN 1 THEN 'Success' ELSE 'Failure' END, severity_id: severity_id, severity: CASE severity_id WHEN 1 THEN 'Informational' WHEN 2 THEN 'Low' ELSE 'High' END,
  metadata: {{product: {{name: 'Application', vendor_name: 'Own'}}, log_name: 'app', log_provider: 'edge-1', processed_time: {ISO.format('+00:00')}, original_time: {ISO.format('Z')}}},
  actor: {{"user": {{name: principal, email_addr: {MAIL.format('principal')}, groups: groups}}, session: {{uid: session_uid}}}},
  "user": CASE WHEN target_principal IS NOT NULL THEN {{name: target_principal, email_addr: {MAIL.format('target_principal')}, type: 'User'}} END,
  src_endpoint: {{ip: source_ip}}, device: {{hostname: hostname}}, api: {{operation: operation}}, http_request: CASE WHEN user_agent IS NOT NULL THEN {{user_agent: user_agent}} END, http_response: {{code: http_code}}, is_mfa: is_mfa, message: message,
  observables: list_filter([{{name: 'src_endpoint.ip', type: 'ip', value: source_ip}}, {{name: 'actor.user.name', type: 'user', value: principal}}, {{name: 'user.name', type: 'user', value: CASE WHEN target_principal <> principal THEN target_principal END}}, {{name: 'device.hostname', type: 'hostname', value: hostname}}], lambda x: x.value IS NOT NULL),
  unmapped: {{action: CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login' WHEN 'purchase' THEN 'role_change' WHEN 'click' THEN 'api_key_created' ELSE 'data_access' END, groups: groups, host: hostname, ip: source_ip, message: message, mfa_used: is_mfa, operation: operation, session_id: session_uid, status_code: http_code, target_user: target_principal, "timestamp": {ISO.format('Z')}, "user": principal, user_agent: user_agent}},
  ev_tenant: tenant, ev_source: 'app.audit', ev_dedup_key: {NESTED_KEY}}}))"""

BOOK.on("norm_stamp", "v_events", f"SELECT event_id, tenant, 'app.audit' AS source, 'Application' AS product, 'Own' AS vendor, 'edge-1' AS provider, t AS processed, {ISO.format('Z')} AS original, t, {NESTED_KEY} AS dedup_key FROM v_events")(
    lambda df: events_of(df).select("event_id", "ocsf.ev_tenant", "ocsf.ev_source", "ocsf.metadata.product.*", "ocsf.metadata.log_provider", F.unix_micros("ocsf.metadata.processed_time"), "ocsf.metadata.original_time", F.unix_micros("ocsf.time"), "ocsf.ev_dedup_key").toDF("event_id", "tenant", "source", "product", "vendor", "provider", "processed", "original", "t", "dedup_key")
)
BOOK.on("norm_observables", "v_events", "SELECT event_id, unnest(list_filter(['src_endpoint.ip|ip|' || source_ip, 'actor.user.name|user|' || principal, CASE WHEN target_principal <> principal THEN 'user.name|user|' || target_principal END, 'device.hostname|hostname|' || hostname], lambda x: x IS NOT NULL)) AS found FROM v_events")(
    # The outer form, since explode adds a filter on the list that is pushed through the projections and maps every record anew for each field.
    lambda df: events_of(df).select("event_id", F.explode_outer("ocsf.observables").alias("o")).where("o IS NOT NULL").select("event_id", F.concat_ws("|", "o.name", "o.type", "o.value").alias("found"))
)
BOOK.on("norm_document", "v_events", f"SELECT event_id, {DOCUMENT}::VARCHAR AS document FROM v_events")(lambda df: events_of(df).select("event_id", E.document().alias("document")))
BOOK.on("norm_vendor_fields", "v_events", "SELECT event_id, unnest(['ip', 'host', 'status_code']) AS key, unnest([source_ip, hostname, http_code::VARCHAR]) AS value FROM v_events UNION ALL SELECT event_id, 'target_user', target_principal FROM v_events WHERE target_principal IS NOT NULL")(
    lambda df: E.vendor_fields(events_of(df)).where(F.col("key").isin("ip", "host", "status_code", "target_user"))
)
BOOK.on("norm_faults", "v_events", "SELECT CASE k % 6 WHEN 4 THEN 'unrecognized record' WHEN 5 THEN 'no mapper for source' WHEN 0 THEN 'tenant' ELSE '' END AS fault, count(*) AS n FROM v_events GROUP BY 1")(lambda df: faulty(df))


def faulty(df: DataFrame) -> DataFrame:
    """Events that the schema check refuses, beside the records that no mapper took."""
    done = E.nested(N.normalize(raw_records(df).withColumn("tenant", F.when(F.col("source") == "linux.sshd", "").otherwise(F.col("tenant")))))
    return done.groupBy(F.coalesce("error", F.array_join(E.faults(), ",")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


BOOK.on("norm_flatten", "v_events", "SELECT event_id, path, value FROM (SELECT event_id, unnest(['actor.user.name', 'device.hostname']) AS path, unnest([principal, hostname]) AS value FROM v_events) UNION ALL SELECT event_id, 'groups', unnest(groups) FROM v_events")(lambda df: flatten(df))


def flatten(df: DataFrame) -> DataFrame:
    """The leaves of a nested event as (path, value) rows."""
    nested = df.select("event_id", F.struct(F.struct(F.struct(F.col("principal").alias("name")).alias("user")).alias("actor"), F.struct("hostname").alias("device"), "groups").alias("event"))
    return nested.select("event_id", F.inline(N.flat(F.col("event"), nested.schema["event"].dataType)))


@BOOK.over("norm_identity", "v_events", "v_users", oracle="""WITH aliases AS (SELECT email AS canonical, user_id % 25 = 0 AS service, unnest([lower(email), CASE WHEN ends_with(lower(email), '@corp.example') THEN split_part(email, '@', 1) END, 'uid-' || user_id]) AS alias FROM v_users)
  SELECT event_id, coalesce(a.canonical, n.canonical, u.canonical) AS canonical, coalesce(a.service, n.service, u.service, false) AS is_service FROM v_events e
  LEFT JOIN aliases a ON a.alias = CASE WHEN k % 3 = 0 THEN 'user' || e.user_id || '@corp.example' END LEFT JOIN aliases n ON n.alias = CASE WHEN k % 3 = 1 THEN 'user' || e.user_id END LEFT JOIN aliases u ON u.alias = 'uid-' || e.user_id""")
def identity(events: DataFrame, users: DataFrame) -> DataFrame:
    """An address, a bare name or a number leads to the person's address."""
    # A bare name is the own domain's: other domains use the same ones.
    bare = F.when(F.lower("email").endswith("@corp.example"), F.substring_index("email", "@", 1))
    own = users.select(F.col("email").alias("canonical"), (F.col("user_id") % 25 == 0).alias("service"), F.explode(F.array(F.lower("email"), bare, F.concat(F.lit("uid-"), F.col("user_id").cast("string")))).alias("alias")).where("alias IS NOT NULL")
    address = F.when(F.col("k") % 3 == 0, F.upper(F.concat(who(), F.lit("@corp.example"))))
    named = events.withColumn("a", address).withColumn("n", F.when(F.col("k") % 3 == 1, who())).withColumn("u", F.concat(F.lit("uid-"), F.col("user_id").cast("string")))
    return N.identities(named, own, "a", "n", "u").select("event_id", "canonical", "is_service")


@BOOK.on("det_nested_paths", "v_events", f"WITH {detection_queries.MATCHED} SELECT event_id, rule_id FROM matched")
def rules_on_events(df: DataFrame) -> DataFrame:
    """The shipped rules on events that were read from records and stored, through their nested paths."""
    made = events_of(df).select("event_id", "ocsf")
    stored = df.sparkSession.read.schema(made.schema).parquet(written(made, "events"))
    return detect.match_rules(E.flat_events(stored), detection_queries.RULES).select("event_id", "rule_id")


@BOOK.on("chain_events", "v_events", "SELECT event_id, CASE WHEN k % 6 < 4 THEN '' WHEN k % 6 = 4 THEN 'unrecognized record' ELSE 'no mapper for source' END AS why FROM v_events")
def chain_events(df: DataFrame) -> DataFrame:
    """The whole chain over records of all sources: which became events, and why the others didn't. Records here differ in content, so none is a repeat."""
    found = chain.run(raw_records(df).withColumn("payload", F.when(F.col("payload").isNotNull(), F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(',"event_id":"'), F.col("event_id").cast("string"), F.lit('"}')))).withColumn("raw", F.when(F.col("raw") == "broken line", F.col("raw")).otherwise(F.concat("raw", F.lit(" #"), F.col("event_id").cast("string")))))
    return found.rejected.select("event_id", "why").union(found.events.select("event_id", F.lit("")))
