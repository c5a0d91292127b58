"""Rules on raw records: cases that must fire, cases that must not, cases that look alike; and the chain up to incidents."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from secflow.operators import chain

START = datetime.datetime(2026, 5, 6, 10, 0, 0)
KIND = "case string, event_id long, source string, tenant string, payload string, raw string, received_at timestamp"


def ssh(at, text, host="gate-1"):
    return ("linux.sshd", at, None, f"{(START + datetime.timedelta(seconds=at)).strftime('%b %d %H:%M:%S')} {host} sshd[{at + 7}]: {text}")


def fails(who, n, every, first=0, ip="198.51.100.7"):
    return [ssh(first + i * every, f"Failed password for {who} from {ip} port {4000 + i} ssh2") for i in range(n)]


def logon(who, at, ip="198.51.100.7"):
    return ssh(at, f"Accepted password for {who} from {ip} port 5000 ssh2")


def app(at, action, user="ann", **more):
    return ("app.audit", at, {"action": action, "user": user, **more}, None)


def cloud(at, name, user="ann", **more):
    return ("aws.cloudtrail", at, {"eventName": name, "eventID": f"{name}{at}", "userIdentity": {"type": "IAMUser", "userName": user}, **more}, None)


def idp(at, country, user="ann@corp.example", result="SUCCESS"):
    return ("okta.system", at, {"eventType": "user.session.start", "uuid": f"u{at}", "outcome": {"result": result}, "actor": {"alternateId": user}, "client": {"ipAddress": "198.51.100.9", "geographicalContext": {"country": country}}}, None)


def ran(at, command, user="ann"):
    return ("linux.sudo", at, None, f"May 06 10:00:{at % 60:02} gate-1 sudo: {user} : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND={command}")


def audit(at, command, exe):
    return ("linux.auditd", at, {"audit_type": "EXECVE", "auid_name": "ann", "cmdline": command, "exe": exe}, None)


TAKEN = [*fails("ann", 5, 10), logon("ann", 70), app(130, "role_change", target_user="bob"), cloud(190, "CreateAccessKey")]
#: Case, records, rules that alert (with their number), takeovers, travels.
CASES = [
    ("five failures", fails("ann", 5, 50), {"auth-failures": 1}, 0, 0),
    ("five failures on the window's edge", fails("ann", 5, 75), {"auth-failures": 1}, 0, 0),
    ("four failures", fails("ann", 4, 10), {}, 0, 0),
    ("failures too far apart", fails("ann", 6, 90), {}, 0, 0),
    ("failures of several people", [r for i in range(5) for r in fails(f"u{i}", 1, 1, i)], {}, 0, 0),
    ("many failures, one alert", fails("ann", 12, 2), {"auth-failures": 1}, 0, 0),
    ("failures after the silence", fails("ann", 5, 10) + fails("ann", 5, 10, 1200), {"auth-failures": 2}, 0, 0),
    ("load test", fails("loadtest-1", 12, 2), {}, 0, 0),
    ("the same line twice", fails("ann", 3, 10) * 2, {}, 0, 0),
    ("logon", [logon("ann", 0)], {"auth-success": 1}, 0, 0),
    ("closed session", [ssh(0, "pam_unix(sshd:session): session closed for user ann")], {}, 0, 0),
    ("logging stopped", [cloud(0, "StopLogging")], {"cloud-logging-off": 1}, 0, 0),
    ("trail deleted, selectors changed", [cloud(0, "DeleteTrail"), cloud(9, "PutEventSelectors")], {"cloud-logging-off": 2}, 0, 0),
    ("logging not stopped", [cloud(0, "StopLogging", errorCode="AccessDenied")], {}, 0, 0),
    ("trail read", [cloud(0, "DescribeTrails")], {}, 0, 0),
    ("console without a factor", [cloud(0, "ConsoleLogin", additionalEventData={"MFAUsed": "No"})], {"auth-success": 1, "cloud-no-mfa": 1}, 0, 0),
    ("console with a factor", [cloud(0, "ConsoleLogin", additionalEventData={"MFAUsed": "Yes"})], {"auth-success": 1}, 0, 0),
    ("console refused", [cloud(0, "ConsoleLogin", additionalEventData={"MFAUsed": "No"}, responseElements={"ConsoleLogin": "Failure"})], {}, 0, 0),
    ("factor turned off", [app(0, "mfa_disabled")], {"idn-mfa-off": 1}, 0, 0),
    ("factor turned off by a job", [app(0, "mfa_disabled", "svc", is_service_account=True)], {}, 0, 0),
    ("factor turned on", [cloud(0, "EnableMFADevice")], {}, 0, 0),
    ("shadow read", [ran(0, "/bin/cat /etc/shadow")], {"end-secrets": 1}, 0, 0),
    ("keys read by a process", [audit(0, "cp /root/.ssh/id /tmp", "/bin/cp")], {"end-secrets": 1}, 0, 0),
    ("backup reads shadow", [audit(0, "backup /etc/shadow", "/usr/sbin/backup-agent")], {}, 0, 0),
    ("harmless command", [ran(0, "/bin/cat /etc/hosts")], {}, 0, 0),
    ("role of another", [app(0, "role_change", target_user="bob")], {"idn-role-change": 1}, 0, 0),
    ("own role", [app(0, "role_change", target_user="ANN")], {}, 0, 0),
    ("role refused", [app(0, "role_change", target_user="bob", status_code=403)], {}, 0, 0),
    ("key", [cloud(0, "CreateAccessKey")], {"cred-key": 1}, 0, 0),
    ("key by a job", [app(0, "api_key_created", "svc", is_service_account=True)], {}, 0, 0),
    ("key read", [cloud(0, "ListAccessKeys")], {}, 0, 0),
    ("two countries", [idp(0, "PT"), idp(1800, "JP")], {"auth-success": 2}, 0, 1),
    ("two countries, too slowly", [idp(0, "PT"), idp(3700, "JP")], {"auth-success": 2}, 0, 0),
    ("one country", [idp(0, "PT"), idp(60, "PT")], {"auth-success": 2}, 0, 0),
    ("two people", [idp(0, "PT"), idp(60, "JP", "bob@corp.example")], {"auth-success": 2}, 0, 0),
    ("second country refused", [idp(0, "PT"), idp(60, "JP", result="FAILURE")], {"auth-success": 1}, 0, 0),
    ("taken account", TAKEN, {"auth-failures": 1, "auth-success": 1, "idn-role-change": 1, "cred-key": 1}, 1, 0),
    ("taken account, others between", [*TAKEN, cloud(100, "StopLogging"), logon("ann", 80)], {"auth-failures": 1, "auth-success": 2, "idn-role-change": 1, "cred-key": 1, "cloud-logging-off": 1}, 1, 0),
    ("key before the role", [*fails("ann", 5, 10), logon("ann", 70), cloud(130, "CreateAccessKey"), app(190, "role_change", target_user="bob")], {"auth-failures": 1, "auth-success": 1, "idn-role-change": 1, "cred-key": 1}, 0, 0),
    ("taken slowly", [*fails("ann", 5, 10), logon("ann", 1000), app(1900, "role_change", target_user="bob"), cloud(2800, "CreateAccessKey")], {"auth-failures": 1, "auth-success": 1, "idn-role-change": 1, "cred-key": 1}, 0, 0),
    ("a stage is missing", [*fails("ann", 5, 10), logon("ann", 70), cloud(190, "CreateAccessKey")], {"auth-failures": 1, "auth-success": 1, "cred-key": 1}, 0, 0),
    ("stages of two people", [*fails("ann", 5, 10), logon("bob", 70), app(130, "role_change", target_user="eve"), cloud(190, "CreateAccessKey")], {"auth-failures": 1, "auth-success": 1, "idn-role-change": 1, "cred-key": 1}, 0, 0),
    ("critical store read", [app(0, "data_access", resource="customers", resource_criticality="critical", record_count=12)], {"app-sensitive-read": 1}, 0, 0),
    ("large export", [app(0, "data_export", resource="bills", resource_criticality="high", record_count=1000)], {"app-sensitive-read": 1}, 0, 0),
    ("export below the limit", [app(0, "data_export", resource="bills", resource_criticality="high", record_count=999)], {}, 0, 0),
    ("wiki read", [app(0, "data_access", object="wiki", resource_criticality="low")], {}, 0, 0),
    ("critical store emptied", [app(0, "data_delete", resource="customers", resource_criticality="critical", record_count=5000)], {}, 0, 0),
    ("job reads its store", [app(0, "data_access", "svc", is_service_account=True, resource="customers", resource_criticality="critical", record_count=25_000)], {}, 0, 0),
    ("guessed in the end", [*fails("ann", 5, 10), logon("ann", 630)], {"auth-failures": 1, "auth-success": 1}, 0, 0),
    ("logon before the failures", [logon("ann", 0), *fails("ann", 5, 10, 5)], {"auth-failures": 1, "auth-success": 1}, 0, 0),
    ("logon after few failures", [*fails("ann", 4, 10), logon("ann", 60)], {"auth-success": 1}, 0, 0),
    ("broken line", [ssh(0, "nothing known"), ("unknown", 1, {"a": 1}, None)], {}, 0, 0),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows, n = [], 0
    for name, records, *_ in CASES:
        for source, at, payload, raw in records:
            n += 1
            rows.append((name, n, source, name, None if payload is None else json.dumps(payload), raw, START + datetime.timedelta(seconds=at)))
    raw = spark.createDataFrame(rows, KIND).drop("case")
    found = chain.run(raw, context=chain.Context(load_test=F.col("principal").startswith("loadtest-")))
    return {f: getattr(found, f).persist() for f in ("rejected", "events", "alerts", "silenced", "hits", "travel", "incidents", "guessed")}


def test_cases(tables):
    """A case is a tenant of its own, so all of them run at once."""
    got = {}
    for r in tables["alerts"].groupBy("tenant", "rule_id").count().collect():
        got.setdefault(r.tenant, {})[r.rule_id] = r["count"]
    count = lambda name: {r.tenant: r["count"] for r in tables[name].groupBy("tenant").count().collect()}
    hits, travel = count("hits"), count("travel")
    for name, _, alerts, taken, apart in CASES:
        assert (got.get(name, {}), hits.get(name, 0), travel.get(name, 0)) == (alerts, taken, apart), name


def test_incident_of_a_taken_account(tables):
    r = {x.tenant: x for x in tables["incidents"].collect()}["taken account"]
    assert (r.principal, r.scenario, r.alerts, r.rules) == ("ann", "account takeover", 4, 4) and r.risk_score >= 70
    assert r.last_seen - r.first_seen == 150_000_000


def test_logons_after_failures(tables):
    got = {(r.tenant, r["count"]) for r in tables["guessed"].groupBy("tenant").count().collect()}
    assert got == {(name, 1) for name in ("taken account", "taken account, others between", "key before the role", "a stage is missing", "guessed in the end")}


def test_nothing_is_lost(tables, spark):
    total = sum(len(records) for _, records, *_ in CASES)
    repeats = 3
    assert tables["events"].count() + tables["rejected"].count() + repeats == total
    assert {r.reason for r in tables["silenced"].collect()} == {"load_test_account"}
    assert {(r.tenant, r.why) for r in tables["rejected"].collect()} == {("broken line", "unrecognized record"), ("broken line", "no mapper for source")}
