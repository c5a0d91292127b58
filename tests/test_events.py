"""The nested event: schema, stamps, faults, documents, vendor fields."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from secflow.operators import events, normalize
from secflow.plans import normalize_queries
from secflow.schema import event_schema

ENVELOPE = "event_id long, source string, tenant string, payload string, raw string, received_at timestamp, collector string"
NOON = datetime.datetime(2026, 3, 4, 12, 0, 0)


def records(spark, *rows):
    return spark.createDataFrame([(i, s, "t", json.dumps(p) if p is not None else None, r, NOON, "edge") for i, (s, p, r) in enumerate(rows)], ENVELOPE)


def made(spark, *rows):
    return events.check_schema(events.nested(normalize.normalize(records(spark, *rows))))


def test_every_source_has_its_place(spark):
    sshd = "Mar  4 11:59:58 db-7 sshd[81]: Failed password for invalid user eve from 198.51.100.4 port 4022 ssh2"
    cloud = {"eventTime": "2026-03-04T11:58:00Z", "eventName": "CreateAccessKey", "eventSource": "iam", "sourceIPAddress": "198.51.100.9", "userAgent": "cli/1", "eventID": "e-1", "userIdentity": {"userName": "ann"}, "requestParameters": {"userName": "bob"}, "responseElements": {"accessKey": {"accessKeyId": "KEY1"}}}
    idp = {"published": "2026-03-04T11:57:00Z", "uuid": "u-1", "eventType": "user.session.start", "outcome": {"result": "SUCCESS"}, "actor": {"alternateId": "ann@corp.example"}, "client": {"ipAddress": "198.51.100.3", "geographicalContext": {"country": "PT"}, "userAgent": {"rawUserAgent": "Own/2"}}}
    app = {"action": "role_change", "user": "ann@corp.example", "target_user": "bob@corp.example", "new_role": "admin", "ip": "10.0.0.1", "host": "web-1", "session_id": "s", "status_code": 200, "groups": ["ops"], "sha256": "ab"}
    rows = {r.event_id: r.ocsf for r in made(spark, ("linux.sshd", None, sshd), ("aws.cloudtrail", cloud, None), ("okta.system", idp, None), ("app.audit", app, None), ("linux.sshd", None, "noise"), ("what", {}, None)).select("event_id", "ocsf").collect()}
    assert rows[4] is None and rows[5] is None
    s, c, i, a = rows[0], rows[1], rows[2], rows[3]
    assert (s.class_uid, s.status, s.actor.user.name, s.src_endpoint.ip, s.src_endpoint.port, s.device.hostname, s.time) == (3002, "Failure", "eve", "198.51.100.4", 4022, "db-7", datetime.datetime(2026, 3, 4, 11, 59, 58))
    assert s.user is None and s.api is None and s.metadata.product.name == "Linux Host" and s.metadata.log_provider == "edge" and s.ev_raw == sshd and s.metadata.original_time == "Mar  4 11:59:58"
    assert (c.actor.user.name, c.user.name, c.api.operation, c.api.service, c.metadata.uid, c.http_request.user_agent) == ("ann", "bob", "CreateAccessKey", "iam", "e-1", "cli/1")
    assert [r.uid for r in c.resources] == ["KEY1"] and c.time == datetime.datetime(2026, 3, 4, 11, 58)
    assert (i.actor.user.email_addr, i.src_endpoint.country, i.http_request.user_agent, i.device) == ("ann@corp.example", "PT", "Own/2", None)
    assert (a.user.email_addr, a.user.type, a.actor.user.groups, a.actor.session.uid, a.http_response.code, a.file.hashes) == ("bob@corp.example", "Admin", ["ops"], "s", 200, {"sha256": "ab"})
    assert [(o.name, o.value) for o in a.observables] == [("src_endpoint.ip", "10.0.0.1"), ("actor.user.name", "ann@corp.example"), ("user.name", "bob@corp.example"), ("device.hostname", "web-1"), ("file.hashes.sha256", "ab")]
    assert len({r.ev_dedup_key for r in (s, c, i, a)}) == 4


def test_documents_and_vendor_fields(spark):
    app = {"action": "login", "user": "ann", "ip": None, "own": {"deep": [1, {"x": "y"}]}, "n": 7}
    df = made(spark, ("app.audit", app, None)).persist()
    doc = json.loads(df.select(events.document().alias("d")).first().d)
    assert doc["actor"] == {"user": {"name": "ann"}} and "user" not in doc and "src_endpoint" not in doc and doc["time"] == "2026-03-04T12:00:00.000000+00:00" and doc["unmapped"]["own"] == app["own"]
    assert {r.key: r.value for r in events.vendor_fields(df).collect()} == {"action": "login", "user": "ann", "ip": None, "own": '{"deep":[1,{"x":"y"}]}', "n": "7"}
    assert df.select(F.variant_get("ocsf.unmapped", "$.own.deep[1].x", "string").alias("v")).first().v == "y"
    df.unpersist()


def test_schema_is_checked(spark):
    good = made(spark, ("app.audit", {"action": "login", "user": "a"}, None))
    assert events.check_schema(good) is good
    with pytest.raises(ValueError, match="severity_id"):
        events.check_schema(good.withColumn("ocsf", F.col("ocsf").dropFields("severity_id")))
    with pytest.raises(ValueError, match="not an event"):
        events.check_schema(spark.range(1).withColumnRenamed("id", "ocsf"))
    with pytest.raises(ValueError, match="actor.shoe"):
        events.assemble(event_schema(), {"actor.shoe": F.lit(1)})


def test_faults(spark):
    df = made(spark, ("app.audit", {"action": "login", "user": "a"}, None))
    broken = {"class_uid": F.lit(1), "time": F.lit(None).cast("timestamp"), "ev_tenant": F.lit(""), "severity_id": F.lit(42), "status_id": F.lit(None).cast("int")}
    for name, value in broken.items():
        got = df.withColumn("ocsf", F.col("ocsf").withField(name, value)).select(events.faults().alias("f")).first().f
        assert got == [name.removeprefix("ev_")]
    assert df.select(events.faults().alias("f")).first().f == []


def test_own_mappers_do_not_leak(spark):
    own = {"door": lambda payload, raw: normalize.made(class_uid=normalize.API, activity_id=1, actor=F.get_json_object(payload, "$.who"))}
    raw = records(spark, ("door.gate", {"who": "eve"}, None))
    assert normalize.normalize(raw, own).first().event.actor == "eve"
    assert normalize.normalize(raw).first().error == "no mapper for source"


def test_empty(spark):
    assert events.nested(normalize.normalize(records(spark, ("x", None, None)).limit(0))).count() == 0


def test_observables_are_listed_without_mapping_a_record_again(spark):
    """No filter on the list is pushed below the mapping, where it would hold the mapping once for each of its fields."""
    plan = normalize_queries.BOOK.queries["norm_observables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "get_json_object" in line]
