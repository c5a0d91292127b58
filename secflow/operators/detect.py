"""Rule evaluation: events to matches to alerts, one scan for all rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.functions import predicates as P
from secflow.functions import risk


@dataclass(frozen=True)
class Rule:
    """A detection rule: named searches, their condition, and what an alert says."""

    id: str
    title: str
    level: str
    searches: dict
    condition: str
    confidence: int = 7
    classes: tuple[int, ...] = ()
    status: str = "stable"
    tags: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    threshold: dict = field(default_factory=dict)


#: The shipped rules over the event view.
RULES = [
    Rule("auth-failures", "Repeated failed logons", "medium", {"selection": [{"operation": "Logon", "status_id": 2}], "filter_service": [{"principal|startswith": "svc-"}]}, "selection AND NOT filter_service", 7, (3002,), tags=("attack.credential_access", "attack.t1110"), fields=("principal", "source_ip"), threshold={"span": 86400, "op": ">=", "value": 3, "by": ["tenant", "principal"]}),
    Rule("auth-success", "Successful logon", "informational", {"selection": [{"operation": "Logon", "status_id": 1}]}, "selection", 5, (3002,), tags=("attack.initial_access", "attack.t1078"), fields=("principal", "hostname")),
    Rule("app-sensitive-read", "Read of a production data store", "medium", {"selection": [{"operation|startswith": "Get", "hostname|contains": "prod"}], "selection_user": [{"groups": ["admins", "wheel"]}, {"principal|contains": "user"}]}, "all of selection*", 6, (6005,), tags=("attack.collection", "attack.t1530"), fields=("hostname",)),
    Rule("cloud-no-mfa", "Logon without a second factor", "high", {"selection": [{"operation": "Logon", "status_id": 1, "is_mfa": False}]}, "selection", 8, (3002,), tags=("attack.initial_access", "attack.t1078.004"), fields=("principal",)),
    Rule("cloud-agent", "Key created by a script", "high", {"selection": [{"operation": "CreateAccessKey"}], "agent": [{"user_agent|startswith": ["curl/", "aws-cli"]}]}, "selection AND agent", 6, (3001,), tags=("attack.persistence", "attack.t1136"), fields=("user_agent",)),
    Rule("cred-key", "Access key created", "medium", {"selection": [{"operation": "CreateAccessKey"}], "filter_service": [{"principal|startswith": "svc-"}]}, "selection AND NOT filter_service", 7, (3001,), tags=("attack.persistence", "attack.credential_access", "attack.t1098.001"), fields=("target_principal",)),
    Rule("end-wheel", "Privileged member on a database host", "critical", {"selection": [{"groups|contains": "wheel", "hostname": "db-*"}]}, "selection", 9, tags=("attack.privilege_escalation", "attack.t1548"), fields=("hostname", "principal")),
    Rule("idn-role-change", "Unexpected role change", "high", {"selection": [{"operation": "AttachUserPolicy"}], "own": [{"principal|fieldref": "target_principal"}]}, "selection AND NOT own", 8, (3005,), tags=("attack.privilege_escalation", "attack.t1098"), fields=("principal", "target_principal")),
    Rule("idn-self-grant", "User raises its own role", "critical", {"selection": [{"operation": "AttachUserPolicy"}], "own": [{"principal|fieldref": "target_principal"}]}, "selection AND own", 9, (3005,), tags=("attack.privilege_escalation", "attack.t1098"), fields=("principal",)),
    Rule("old-rule", "Superseded", "low", {"selection": [{"operation": "Logon"}]}, "selection", status="deprecated"),
]


#: Rules over normalized records, with what a window must hold before they fire: events within seconds, per principal.
RECORD_RULES = [
    Rule("app-sensitive-read", "Critical or bulk data read", "medium", {"selection": [{"class_uid": 6005, "activity_id": [1, 4]}], "trigger_level": [{"resource_levels": "critical"}], "trigger_volume": [{"record_count|gte": 1000}], "service": [{"principal_type": "Service"}]}, "selection AND 1 of trigger_* AND NOT service", 7, (6005,), tags=("attack.collection", "attack.t1530"), fields=("record_count",)),
    Rule("auth-failures", "Repeated failed logons", "medium", {"selection": [{"class_uid": 3002, "activity_id": 1, "status_id": 2}]}, "selection", 7, (3002,), tags=("attack.credential_access", "attack.t1110"), threshold={"count": 5, "span": 300}),
    Rule("auth-success", "Successful logon", "informational", {"selection": [{"class_uid": 3002, "activity_id": 1, "status_id": 1}]}, "selection", 5, (3002,), tags=("attack.initial_access", "attack.t1078")),
    Rule("cloud-no-mfa", "Console logon without a second factor", "high", {"selection": [{"operation": "ConsoleLogin", "status_id": 1, "is_mfa": False}], "federated": [{"logon_type": "SAML"}]}, "selection AND NOT federated", 8, tags=("attack.initial_access", "attack.t1078.004")),
    Rule("cloud-logging-off", "Audit logging turned off", "critical", {"selection": [{"operation": ["StopLogging", "DeleteTrail", "PutEventSelectors"]}], "refused": [{"status_id": 2}]}, "selection AND NOT refused", 9, tags=("attack.defense_evasion", "attack.t1562.008")),
    Rule("cred-key", "Access key created", "medium", {"selection": [{"class_uid": 3001, "activity_id": 1, "operation": ["CreateAccessKey", "api_key_created", "system.api_token.create"]}], "service": [{"principal_type": "Service"}]}, "selection AND NOT service", 7, tags=("attack.persistence", "attack.t1098.001")),
    Rule("end-secrets", "Local credential store read", "high", {"selection": [{"command|contains": ["/etc/shadow", "/etc/sudoers", "/root/.ssh/"]}], "agent": [{"process|endswith": ["/backup-agent", "/aide"]}]}, "selection AND NOT agent", 8, tags=("attack.credential_access", "attack.t1003.008")),
    Rule("idn-mfa-off", "Second factor turned off", "high", {"selection": [{"class_uid": 3001, "activity_id": 11}], "service": [{"principal_type": "Service"}]}, "selection AND NOT service", 9, tags=("attack.persistence", "attack.t1556.006")),
    Rule("idn-role-change", "Unexpected role change", "high", {"selection": [{"class_uid": 3005, "activity_id": 1, "status_id": 1}], "own": [{"principal|fieldref": "target_principal"}]}, "selection AND NOT own", 8, tags=("attack.privilege_escalation", "attack.t1098")),
]


def usable(rules: Sequence[Rule], min_level: str = "informational", deprecated: bool = False) -> list[Rule]:
    """Rules of at least a level, without deprecated and unsupported ones."""
    order = list(risk.LEVELS)
    return [r for r in rules if order.index(r.level) >= order.index(min_level) and (deprecated or r.status not in ("deprecated", "unsupported"))]


def rule_column(df: DataFrame, rule: Rule) -> tuple[dict[str, Column], Column]:
    """The rule's searches and its whole condition as columns."""
    searches = {n: P.search(df.schema, g) for n, g in rule.searches.items()}
    return searches, rule_class(rule)


def rule_class(rule: Rule) -> Column:
    return F.col("class_uid").isin(*rule.classes) if rule.classes else F.lit(True)


def match_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per event and rule that it matches: rule_id, matched search names; every rule is evaluated in one scan."""
    classes = sorted({c for r in rules for c in r.classes})
    # Where every rule names its classes, no other event needs to leave the scan.
    out, arms = df.where(F.col("class_uid").isin(*classes)) if all(r.classes for r in rules) else df, []
    for i, r in enumerate(rules):
        searches, own_class = rule_column(df, r)
        names = {f"_{i}_{n}": c for n, c in searches.items()}
        text = r.condition
        out = out.withColumns(names)
        out = P.with_condition(out, {n: F.col(f"_{i}_{n}") for n in searches}, text, f"_{i}")
        hit = F.array_compact(F.array(*(F.when(F.col(f"_{i}_{n}"), F.lit(n)) for n in searches)))
        arms.append(F.when(own_class & F.col(f"_{i}"), F.struct(F.lit(r.id).alias("rule_id"), hit.alias("searches"))))
    found = out.withColumn("_m", F.explode(F.array_compact(F.array(*arms))))
    return found.select(*df.columns, "_m.rule_id", "_m.searches")


def _shown(schema: T.StructType, name: str) -> Column:
    """A field as (name, text), null where the event lacks it; lists as JSON."""
    kind = schema[name].dataType
    text = F.to_json(name) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.col(name).cast("string")
    return F.when(text.isNotNull(), F.struct(F.lit(name).alias("key"), text.alias("value")))


def with_evidence(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``evidence``, a map of field to text: for each search that matched the fields of its first group that holds, then the rule's display fields.

    Only matched rows are looked at again. Fields that the event lacks are left out; a field
    that several searches name is told once.
    """
    schema, none = matches.schema, F.array().cast("array<struct<key:string,value:string>>")
    found = F.when(F.lit(False), none)
    for r in rules:
        parts = []
        for n, groups in r.searches.items():
            own = F.when(F.lit(False), none)
            for g in groups:
                names = dict.fromkeys(P.resolve(f.split("|")[0], schema) for f in g)
                own = own.when(P.search(schema, [g]), F.array(*(_shown(schema, c) for c in names if c in schema.names)))
            parts.append(F.when(F.array_contains("searches", n), F.coalesce(own, none)).otherwise(none))
        told = [_shown(schema, c) for c in (P.resolve(f, schema) for f in r.fields) if c in schema.names]
        whole = F.concat(*parts, F.array(*told)) if told else F.concat(*parts)
        found = found.when(F.col("rule_id") == r.id, F.array_distinct(F.array_compact(whole)))
    return matches.withColumn("evidence", F.map_from_entries(F.coalesce(found, none)))


def rule_table(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rules as a dimension: a few rows."""
    rows = [(r.id, r.title, r.level, r.confidence, [t for t in r.tags], list(r.fields)) for r in rules]
    kind = T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("level", T.StringType()), T.StructField("confidence", T.IntegerType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("fields", T.ArrayType(T.StringType()))])
    return df.sparkSession.createDataFrame(rows, kind)


def tactics(tags: Column) -> Column:
    """Tactic slugs among ``attack.`` tags, unique, in order."""
    own = F.filter(tags, lambda t: t.startswith("attack.") & ~t.rlike(r"^attack\.[tsg]\d"))
    return F.array_distinct(F.transform(own, lambda t: F.replace(F.substring(t, 8, 100), F.lit("_"), F.lit("-"))))


def techniques(tags: Column) -> Column:
    """Technique ids among ``attack.`` tags, upper case, unique, in order."""
    own = F.filter(tags, lambda t: t.rlike(r"^attack\.t\d"))
    return F.array_distinct(F.transform(own, lambda t: F.upper(F.substring(t, 8, 100))))


def dedup_key(*parts: Column) -> Column:
    """32 hex digits over the parts; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def entity_keys(principal: Column, ip: Column, host: Column, session: Column) -> Column:
    """``user:``, ``ip:``, ``host:`` and ``session:`` keys of what is known."""
    pairs = (("user:", F.lower(principal)), ("ip:", ip), ("host:", F.lower(host)), ("session:", session))
    return F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(p), c)) for p, c in pairs)))


def alerts(matches: DataFrame, rules: Sequence[Rule], criticality: Column, factor: Column) -> DataFrame:
    """Matches to alert rows with entities, severity and risk."""
    made = matches.join(F.broadcast(rule_table(matches, rules)), "rule_id")  # a rule list is a few rows
    severity = risk.level_severity(F.col("level"))
    return made.withColumn("severity", severity).withColumn("risk_score", risk.alert_score(severity, F.col("confidence"), criticality, factor)).withColumn("risk_level", risk.band(F.col("risk_score"))).withColumn("dedup_key", dedup_key(*map(F.col, ("tenant", "rule_id", "principal", "source_ip", "hostname", "session_uid"))))
