"""Filters and predicates over the event view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.functions import predicates as P
from secflow.operators import search as S
from secflow.plans.base import ADDRESS_SQL, Book

BOOK = Book()

#: (query, field, values, modifiers, DuckDB condition)
CASES = [
    ("pred_eq_ci", "User", ["USER8@corp.EXAMPLE", "nobody"], (), "lower(principal) = 'user8@corp.example'"),
    ("pred_cased", "operation", ["Logon"], ("cased",), "operation = 'Logon'"),
    ("pred_in", "country", ["us", "Jp"], (), "lower(country) IN ('us', 'jp')"),
    ("pred_all", "groups", ["ops", "staff"], ("all",), "coalesce(list_contains(list_transform(groups, lambda x: lower(x)), 'ops') AND list_contains(list_transform(groups, lambda x: lower(x)), 'staff'), false)"),
    ("pred_wildcard", "hostname", ["DB-*-?"], (), "regexp_full_match(lower(hostname), 'db-.*-.')"),
    ("pred_contains", "useragent", ["LINUX"], ("contains",), "coalesce(contains(lower(user_agent), 'linux'), false)"),
    ("pred_startswith", "user_agent", ["Curl/", "aws*2"], ("startswith",), "coalesce(starts_with(lower(user_agent), 'curl/') OR regexp_full_match(lower(user_agent), 'aws.*2.*'), false)"),
    ("pred_endswith", "user_agent", ["python"], ("endswith",), "coalesce(ends_with(lower(user_agent), 'python'), false)"),
    ("pred_regex", "message", [r"ERROR by user\d+1 k=[5-9]"], ("re", "i"), r"regexp_matches(message, '(?i)ERROR by user\d+1 k=[5-9]')"),
    ("pred_cidr", "source_ip", ["10.0.0.0/9", "203.0.113.64/26"], ("cidr",), f"""{ADDRESS_SQL.format('source_ip')} AND (
        (string_split(source_ip, '.')[1] = '10' AND string_split(source_ip, '.')[2]::INT < 128) OR
        (starts_with(source_ip, '203.0.113.') AND string_split(source_ip, '.')[4]::INT BETWEEN 64 AND 127))"""),
    ("pred_compare", "k", [40], ("gte",), "k >= 40"),
    ("pred_numeric", "http_code", [403], (), "http_code = 403"),
    ("pred_bool", "is_mfa", [True], (), "coalesce(is_mfa, false)"),
    ("pred_exists", "user_agent", [False], ("exists",), "user_agent IS NULL"),
    ("pred_null", "target_principal", [None, "user7@corp.example"], (), "target_principal IS NULL OR target_principal = 'user7@corp.example'"),
    ("pred_fieldref", "principal", ["target_principal"], ("fieldref",), "coalesce(lower(principal) = lower(target_principal), false)"),
    ("pred_field_alias", "SourceIPAddress", ["203.0.113.*"], (), "starts_with(source_ip, '203.0.113.')"),
]


def _case(field: str, values: list, mods: tuple):
    return lambda df: df.where(P.predicate(df.schema, field, values, mods)).select("event_id", "principal")


for _name, _field, _values, _mods, _duck in CASES:
    BOOK.on(_name, "v_events", f"SELECT event_id, principal FROM v_events WHERE {_duck}")(_case(_field, _values, _mods))


@BOOK.on("pred_base64", "v_events", "SELECT event_id FROM v_events WHERE contains(base64(encode(message)), base64(encode('click by user'))[1:16])")
def base64_value(df: DataFrame) -> DataFrame:
    """Base64 of the field's text holds the value's base64 (a multiple of three bytes, so no offset)."""
    coded = df.withColumn("coded", F.base64(F.col("message").cast("binary")))
    return coded.where(P.predicate(coded.schema, "coded", ["click by use"], ("base64", "contains"))).select("event_id")


@BOOK.on("pred_base64offset", "v_events", "SELECT event_id FROM v_events WHERE contains(message, 'purchase by')")
def base64_offset(df: DataFrame) -> DataFrame:
    """Any of the three offset forms finds the value wherever it stands in the coded text."""
    coded = df.withColumn("coded", F.base64(F.col("message").cast("binary")))
    return coded.where(P.predicate(coded.schema, "coded", ["purchase by"], ("base64offset", "contains"))).select("event_id")


@BOOK.on("pred_windash", "v_events", "SELECT event_id FROM v_events WHERE contains(hostname, '-prod') AND k % 3 = 0 OR contains(hostname, '-prod') AND k % 3 <> 0")
def windash(df: DataFrame) -> DataFrame:
    """A leading dash also matches its typographic variants."""
    varied = df.withColumn("hostname", F.when(F.col("k") % 3 == 0, F.regexp_replace("hostname", "-prod", "–prod")).otherwise(F.col("hostname")))
    return varied.where(P.predicate(varied.schema, "hostname", ["-prod"], ("contains", "windash"))).select("event_id")


@BOOK.on("pred_keyword", "v_events", "SELECT event_id FROM v_events WHERE concat_ws(chr(10), event_id::VARCHAR, message, principal, hostname, array_to_string(groups, chr(10))) ILIKE '%wheel%' OR hostname ILIKE '%DB-PROD-1%'")
def keyword(df: DataFrame) -> DataFrame:
    return df.where(P.keyword(df.schema, ["Wheel", "db-prod-1"])).select("event_id")


SEARCHES = {"selection": [{"operation": "Logon", "http_code|gte": 400}], "selection_key": [{"operation|startswith": "create"}, {"operation|endswith": "policy"}], "filter_service": [{"principal|startswith": "svc-"}]}


@BOOK.on("pred_search", "v_events", "SELECT event_id FROM v_events WHERE starts_with(operation, 'Create') OR ends_with(operation, 'Policy')")
def named_search(df: DataFrame) -> DataFrame:
    return df.where(P.search(df.schema, SEARCHES["selection_key"])).select("event_id")


@BOOK.on("pred_condition", "v_events", "SELECT event_id, ((operation = 'Logon' AND http_code >= 400) OR starts_with(operation, 'Create') OR ends_with(operation, 'Policy')) AND NOT starts_with(principal, 'svc-') AS matched FROM v_events")
def named_condition(df: DataFrame) -> DataFrame:
    searches = {n: P.search(df.schema, g) for n, g in SEARCHES.items()}
    return P.with_condition(df, searches, "1 of selection* and not filter_service").select("event_id", "matched")


@BOOK.on("pred_logsource", "v_events", "SELECT event_id FROM v_events WHERE class_uid IN (3001, 3005) AND tenant = 't1'")
def logsource(df: DataFrame) -> DataFrame:
    return df.where(S.logsource("account") & (F.col("tenant") == "t1")).select("event_id")


@BOOK.on("pred_tenant", "v_events", "SELECT event_id, tenant <> 't1' AS elsewhere FROM v_events")
def tenant(df: DataFrame) -> DataFrame:
    return S.tenant_rows(df, "t1", df.select("event_id"), "event_id").select("event_id", "elsewhere")


@BOOK.on("pred_event_search", "v_events", """SELECT event_id FROM v_events WHERE tenant = 't2' AND class_uid IN (3001, 3002) AND severity_id >= 2
  AND (lower(principal) = 'user8@corp.example' OR lower(target_principal) = 'user8@corp.example' OR hostname = 'web-2') AND status_id = 2 AND t >= 1704240000000000 AND t < 1706000000000000""")
def event_search(df: DataFrame) -> DataFrame:
    by_user = S.event_search(tenant="t2", classes=[3001, 3002], principal="User8@corp.example", min_severity=2, status_id=2, start=1704240000000000, end=1706000000000000)
    by_host = S.event_search(tenant="t2", classes=[3001, 3002], hostname="web-2", min_severity=2, status_id=2, start=1704240000000000, end=1706000000000000)
    return df.where(by_user | by_host).select("event_id")


@BOOK.on("pred_full_text", "v_events", "SELECT event_id FROM v_events WHERE contains(lower(message), 'by user77 ') OR contains(lower(coalesce(user_agent, '')), 'by user77 ')")
def full_text(df: DataFrame) -> DataFrame:
    return df.where(S.full_text(df.schema, "BY user77 ")).select("event_id")


@BOOK.on("pred_dsl", "v_events", """SELECT event_id FROM v_events WHERE class_uid = 3002 AND country IN ('US', 'DE') AND k BETWEEN 10 AND 60
  AND NOT coalesce(starts_with(user_agent, 'curl'), false) AND (user_agent IS NOT NULL OR hostname LIKE 'web%')""")
def filter_data(df: DataFrame) -> DataFrame:
    spec = {"bool": {
        "must": [{"term": {"class_uid": 3002}}, {"terms": {"country": ["US", "DE"]}}, {"range": {"k": {"gte": 10, "lte": 60}}}],
        "must_not": [{"prefix": {"user_agent": "curl"}}],
        "should": [{"exists": {"field": "user_agent"}}, {"wildcard": {"hostname": "web*"}}],
    }}
    return df.where(S.filter_spec(spec)).select("event_id")
