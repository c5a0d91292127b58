"""The nested event: built from normalized records, checked, flattened for rules, written as a document.

The event is one struct column of the fixed schema in ``secflow.schema``. A part (an actor, an
endpoint) is null where nothing of it is known, so documents carry no empty parts and scans
read only the leaves that a query names. The vendor's record stays whole as a VARIANT, so its
own fields can be asked for by path or listed as rows without a schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.functions.times import parse_time
from secflow.operators import normalize as N
from secflow.schema import CLASSES, event_schema

#: Product and vendor of each mapper's records.
PRODUCTS = {"linux": ("Linux Host", "Linux"), "aws.cloudtrail": ("AWS CloudTrail", "AWS"), "okta": ("Okta System Log", "Okta"), "app": ("Application", "Own")}
#: Leaves that rules, windows and sinks use, under the names that they know them by.
FLAT = {
    "class_uid": "class_uid", "activity_id": "activity_id", "status_id": "status_id", "severity_id": "severity_id", "tenant": "ev_tenant", "source_ip": "src_endpoint.ip", "hostname": "device.hostname",
    "session_uid": "actor.session.uid", "operation": "api.operation", "user_agent": "http_request.user_agent", "http_code": "http_response.code", "is_mfa": "is_mfa", "path": "file.path", "command": "actor.process.cmd_line",
    "group_name": "group.name", "country": "src_endpoint.country", "status_detail": "status_detail", "message": "message", "dedup_key": "ev_dedup_key",
    "principal_type": "actor.user.type", "logon_type": "logon_type", "process": "actor.process.name",
}


def assemble(kind: T.StructType, leaves: dict[str, Column], path: str = "") -> Column:
    """A struct of a schema from the columns of its leaves, by dotted path; null where all of it is null. A path that the schema lacks is an error."""
    if not path:
        names = set(_paths(kind))
        wrong = sorted(set(leaves) - names)
        if wrong:
            raise ValueError(f"not in the event's schema: {', '.join(wrong)}")
    parts = []
    for f in kind.fields:
        own = f"{path}{f.name}"
        if own in leaves:
            column = leaves[own].cast(f.dataType)
        elif isinstance(f.dataType, T.StructType) and any(n.startswith(own + ".") for n in leaves):
            column = assemble(f.dataType, leaves, own + ".")
        else:
            column = F.lit(None).cast(f.dataType)
        parts.append((f.name, column, own in leaves or any(n.startswith(own + ".") for n in leaves)))
    made = F.struct(*(c.alias(n) for n, c, _ in parts))
    told = [c.isNotNull() for _, c, given in parts if given]
    return F.when(reduce(Column.__or__, told), made) if told else F.lit(None).cast(kind)


def _paths(kind: T.StructType, path: str = "") -> list[str]:
    """All paths of a schema, of structs and of leaves."""
    found = []
    for f in kind.fields:
        found.append(f"{path}{f.name}")
        if isinstance(f.dataType, T.StructType):
            found += _paths(f.dataType, f"{path}{f.name}.")
    return found


def address(name: Column) -> Column:
    """The name, where it is a mail address."""
    return F.when(name.contains("@"), name)


def nested(normalized: DataFrame, event: str = "ocsf") -> DataFrame:
    """Adds the nested event to records that :func:`normalize.normalize` mapped; null where it mapped none.

    Stamps the record's tenant, source, text, collector and times, resolves names, and adds
    the content hash and the observables.
    """
    e = lambda n: F.col(f"event.{n}")
    # The record is parsed once; its fields are then found by offset.
    own = lambda *names: F.coalesce(*(F.try_variant_get("_record", f"$.{n}", "string") for n in names))
    collector = F.col("collector") if "collector" in normalized.columns else F.lit(None).cast("string")
    # What several leaves need, and then each leaf, is a column of its own, so that it is computed once a row.
    known = F.col("event").isNotNull()
    parsed = normalized.withColumns({"_record": F.when(known, F.try_parse_json("payload")), "_line": F.when(known, N.syslog(F.col("raw")))})
    parsed = parsed.withColumns({
        "_original": F.coalesce(own("timestamp", "eventTime", "published"), F.col("_line.timestamp")), "_host": F.coalesce(own("host"), F.col("_line.host")), "_uid": own("eventID", "uuid", "event_id"),
        "_operation": F.coalesce(own("eventName", "eventType", "endpoint", "operation"), e("operation")), "_url": own("path", "url"), "_sha256": own("sha256"), "_message": own("message"),
    })
    parsed = parsed.withColumn("_time", F.coalesce(parse_time(F.col("_original"), F.col("received_at")), F.col("received_at")))
    original, host, uid, operation, url, sha256, message, time = (F.col(f"_{n}") for n in ("original", "host", "uid", "operation", "url", "sha256", "message", "time"))
    product = F.create_map(*(x for k, (p, v) in PRODUCTS.items() for x in (F.lit(k), F.struct(F.lit(p).alias("name"), F.lit(v).alias("vendor_name")))))
    named = N.labels(e("class_uid"), e("activity_id"), e("status_id"), e("severity_id"))
    target = e("target")
    key = N.content_key(F.col("tenant"), e("class_uid"), e("activity_id"), time, e("actor"), target, e("ip"), host, e("status_id"), operation, uid, F.coalesce(F.col("raw"), message))
    seen = N.observables(src_endpoint__ip=("ip", e("ip")), actor__user__name=("user", F.coalesce(e("actor"), target)), user__name=("user", target), device__hostname=("hostname", host), file__hashes__sha256=("file_hash", sha256), http_request__url=("url", url))
    leaves = {
        "class_uid": e("class_uid"), "activity_id": e("activity_id"), "status_id": e("status_id"), "severity_id": e("severity_id"), "status_detail": e("status_detail"), **named, "time": time,
        "metadata.product": product[F.col("mapper")], "metadata.uid": uid, "metadata.log_name": F.col("mapper"), "metadata.log_provider": collector, "metadata.processed_time": F.col("received_at"), "metadata.original_time": original,
        "actor.user.name": e("actor"), "actor.user.email_addr": address(e("actor")), "actor.user.type": F.when(own("is_service_account") == "true", "Service").otherwise(own("userIdentity.type")), "actor.user.groups": F.from_json(own("groups"), "array<string>"), "actor.session.uid": e("session"), "actor.process.cmd_line": e("command"), "actor.process.name": own("exe", "comm"),
        "user.name": target, "user.email_addr": address(target), "user.type": F.when(target.isNotNull(), e("target_type")), "user.groups": F.when(target.isNotNull() & e("group_name").isNotNull(), F.array(e("group_name"))),
        "src_endpoint.ip": e("ip"), "src_endpoint.port": e("port"), "src_endpoint.country": own("client.geographicalContext.country", "country"), "device.hostname": host,
        "api.operation": operation, "api.service": own("eventSource", "service"), "http_request.url": url, "http_request.http_method": own("method"), "http_request.user_agent": own("userAgent", "user_agent", "client.userAgent.rawUserAgent"), "http_response.code": own("status_code").try_cast("int"),
        "resources": F.when(F.col("mapper") == "aws.cloudtrail", F.nullif(N.cloud_resources(F.col("payload")), F.array().cast("array<struct<uid:string,name:string,type:string,criticality:string>>"))).when(F.col("mapper") == "app", N.app_resource(own("resource", "object"), own("resource_id"), own("resource_type"), own("resource_criticality"))),
        "file.path": F.when(e("class_uid") == N.FILE, e("path")), "file.hashes": F.when(sha256.isNotNull(), F.create_map(F.lit("sha256"), sha256)), "group.name": e("group_name"),
        "auth_protocol": e("method"), "logon_type": e("logon_type"), "is_mfa": e("is_mfa"), "message": F.coalesce(message, F.when(F.col("raw").isNotNull(), F.col("_line.message"))), "observables": F.when(F.size("_seen") > 0, F.col("_seen")),
        "unmapped": F.col("_record"), "ev_tenant": F.col("tenant"), "ev_source": F.col("source"), "ev_raw": F.col("raw"), "ev_dedup_key": key,
    }
    named = {path: f"_leaf_{i}" for i, path in enumerate(leaves)}
    made = parsed.withColumn("_seen", F.when(known, seen)).withColumns({named[path]: c for path, c in leaves.items()})
    whole = made.withColumn(event, F.when(known, assemble(event_schema(), {path: F.col(n) for path, n in named.items()})))
    return whole.drop("_record", "_line", "_original", "_host", "_uid", "_operation", "_url", "_sha256", "_message", "_time", "_seen", *named.values())


def check_schema(df: DataFrame, event: str = "ocsf") -> DataFrame:
    """The DataFrame itself, if its event has the event's schema; an error that names the first differences otherwise."""
    have, want = df.schema[event].dataType, event_schema()
    told = lambda kind: {(p, f.dataType.simpleString()) for p, f in _leaves(kind)}
    if not isinstance(have, T.StructType) or told(have) != told(want):
        odd = sorted(told(have) ^ told(want))[:5] if isinstance(have, T.StructType) else [(event, have.simpleString())]
        raise ValueError(f"not an event: {odd}")
    return df


def _leaves(kind: T.StructType, path: str = "") -> list[tuple[str, T.StructField]]:
    found = []
    for f in kind.fields:
        found += _leaves(f.dataType, f"{path}{f.name}.") if isinstance(f.dataType, T.StructType) else [(f"{path}{f.name}", f)]
    return found


def faults(event: str = "ocsf") -> Column:
    """What is wrong with an event, as an array of words: what a store would refuse."""
    e = lambda n: F.col(f"{event}.{n}")
    tests = {
        "class_uid": e("class_uid").isNull() | ~e("class_uid").isin(*CLASSES),
        "time": e("time").isNull(),
        "tenant": F.coalesce(e("ev_tenant"), F.lit("")) == "",
        "severity_id": ~F.coalesce(e("severity_id").between(0, 6) | (e("severity_id") == 99), F.lit(False)),
        "status_id": ~F.coalesce(e("status_id").isin(0, 1, 2, 99), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))


def flat_events(df: DataFrame, event: str = "ocsf", id_column: str = "event_id") -> DataFrame:
    """Events as the columns that rules and windows know, each read from its nested path."""
    who = lambda part: F.coalesce(F.col(f"{event}.{part}.email_addr"), F.col(f"{event}.{part}.name"))
    own = {n: F.col(f"{event}.{p}") for n, p in FLAT.items()}
    levels = F.transform(F.col(f"{event}.resources"), lambda r: r["criticality"]).alias("resource_levels")
    count = F.try_variant_get(F.col(f"{event}.unmapped"), "$.record_count", "string").try_cast("long").alias("record_count")
    return df.where(F.col(event).isNotNull()).select(id_column, levels, count, F.unix_micros(f"{event}.time").alias("t"), F.coalesce(who("actor.user"), who("user")).alias("principal"), who("user").alias("target_principal"), F.col(f"{event}.actor.user.groups").alias("groups"), *(c.alias(n) for n, c in own.items()))


def document(event: str = "ocsf") -> Column:
    """The event as JSON text without nulls."""
    return F.to_json(event, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"})


def vendor_fields(df: DataFrame, id_column: str = "event_id", event: str = "ocsf") -> DataFrame:
    """The vendor's own top-level fields, one row each: id, key, value as text."""
    fields = F.try_variant_get(F.col(f"{event}.unmapped"), "$", "map<string, variant>")
    rows = df.select(id_column, F.explode(fields).alias("key", "value"))
    return rows.select(id_column, "key", F.col("value").cast("string").alias("value"))
