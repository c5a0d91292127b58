"""The normalized event and its parts."""

from __future__ import annotations

from pyspark.sql import types as T

USER = "STRUCT<name: STRING, uid: STRING, email_addr: STRING, type: STRING, groups: ARRAY<STRING>>"
ENDPOINT = "STRUCT<ip: STRING, port: INT, hostname: STRING, country: STRING>"
RESOURCE = "STRUCT<uid: STRING, name: STRING, type: STRING, criticality: STRING>"
#: One nested row per event; the vendor's own record stays whole in ``unmapped``. Names that start with ev_ are bookkeeping.
EVENT_DDL = f"""
class_uid INT, class_name STRING, category_uid INT, activity_id INT, type_uid INT, time TIMESTAMP,
status_id INT, status STRING, status_detail STRING, severity_id INT, severity STRING,
metadata STRUCT<product: STRUCT<name: STRING, vendor_name: STRING>, uid: STRING, log_name: STRING, log_provider: STRING, processed_time: TIMESTAMP, original_time: STRING>,
actor STRUCT<user: {USER}, session: STRUCT<uid: STRING>, process: STRUCT<name: STRING, cmd_line: STRING>>,
user {USER}, src_endpoint {ENDPOINT}, dst_endpoint {ENDPOINT}, device STRUCT<hostname: STRING, ip: STRING>,
api STRUCT<operation: STRING, service: STRING>, http_request STRUCT<url: STRING, http_method: STRING, user_agent: STRING>, http_response STRUCT<code: INT>,
resources ARRAY<{RESOURCE}>, file STRUCT<name: STRING, path: STRING, hashes: MAP<STRING, STRING>>, group STRUCT<name: STRING>,
auth_protocol STRING, logon_type STRING, is_mfa BOOLEAN, message STRING, observables ARRAY<STRUCT<name: STRING, type: STRING, value: STRING>>, unmapped VARIANT,
ev_tenant STRING, ev_source STRING, ev_raw STRING, ev_dedup_key STRING
"""


def event_schema() -> T.StructType:
    return T.StructType.fromDDL(EVENT_DDL)


#: Class, activity, severity and status labels.
CLASSES = {1001: "File System Activity", 1007: "Process Activity", 3001: "Account Change", 3002: "Authentication", 3003: "Authorize Session", 3004: "Entity Management", 3005: "User Access Management", 3006: "Group Management", 4002: "HTTP Activity", 6003: "API Activity", 6005: "Datastore Activity"}
SEVERITIES = {0: "Unknown", 1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical", 6: "Fatal"}
STATUSES = {0: "Unknown", 1: "Success", 2: "Failure"}
#: Rule level to severity score.
LEVELS = {"informational": 1, "low": 3, "medium": 5, "high": 8, "critical": 10}
#: Kill-chain order of tactics: slug, id, name.
TACTICS = [
    ("reconnaissance", "TA0043", "Reconnaissance"), ("resource-development", "TA0042", "Resource Development"), ("initial-access", "TA0001", "Initial Access"),
    ("execution", "TA0002", "Execution"), ("persistence", "TA0003", "Persistence"), ("privilege-escalation", "TA0004", "Privilege Escalation"),
    ("defense-evasion", "TA0005", "Defense Evasion"), ("credential-access", "TA0006", "Credential Access"), ("discovery", "TA0007", "Discovery"),
    ("lateral-movement", "TA0008", "Lateral Movement"), ("collection", "TA0009", "Collection"), ("command-and-control", "TA0011", "Command and Control"),
    ("exfiltration", "TA0010", "Exfiltration"), ("impact", "TA0040", "Impact"),
]
