"""Detection predicates: small declarative specs become Columns.

A spec is ``{"field": name, "mods": [...], "values": [...]}``. Without modifiers a value
matches case-insensitively, may hold the globs ``*`` and ``?`` (``\\`` escapes them), and
several values are alternatives. Array fields match if any element does. Every predicate
is two-valued: a null field is no match, so its negation holds.
"""

from __future__ import annotations

import base64
import ipaddress
import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.functions.net import ipv4, ipv6

ENCODINGS = {"utf8": "utf-8", "utf16le": "utf-16-le", "wide": "utf-16-le", "utf16be": "utf-16-be", "utf16": "utf-16"}
DASHES = "-/–—―"
FLAGS = {"i": "i", "m": "m", "s": "s"}
COMPARE: dict[str, Callable[[Column, float], Column]] = {"lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v}
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")

#: Vendor field names and the normalized columns they mean.
ALIASES = {
    "user": "principal", "username": "principal", "subjectusername": "principal", "actor": "principal", "useridentity.username": "principal", "email": "principal", "useremail": "principal", "user.name": "principal", "actor.user.name": "principal", "useridentity.arn": "principal",
    "subjectusersid": "principal_uid", "useridentity.principalid": "principal_uid", "useridentity.type": "principal_type",
    "targetusername": "target_principal", "target_user": "target_principal", "targetuser": "target_principal", "target.user": "target_principal", "requestparameters.username": "target_principal",
    "group": "group_name", "groupname": "group_name", "targetgroupname": "group_name", "user.groups.name": "groups",
    "sourceip": "source_ip", "src_ip": "source_ip", "srcip": "source_ip", "ipaddress": "source_ip", "clientip": "source_ip", "client.ip": "source_ip", "sourceipaddress": "source_ip", "src_endpoint.ip": "source_ip",
    "sourceport": "source_port", "destinationip": "target_ip", "dst_ip": "target_ip", "destinationport": "target_port",
    "computer": "hostname", "computername": "hostname", "host": "hostname", "workstationname": "hostname", "device.hostname": "hostname",
    "commandline": "command", "image": "process", "processname": "process", "parentimage": "parent_process", "targetfilename": "path", "filepath": "path", "filename": "file_name", "sha256": "file_sha256", "md5": "file_md5",
    "eventname": "operation", "action": "operation", "api.operation": "operation", "eventsource": "service", "awsregion": "region", "errorcode": "status_code", "eventtype": "vendor_event_type",
    "useragent": "user_agent", "c-useragent": "user_agent", "http_request.user_agent": "user_agent", "c-uri": "url", "cs-uri": "url", "uri": "url", "method": "http_method", "cs-method": "http_method",
    "sc-status": "http_code", "statuscode": "http_code", "status_code": "http_code", "http_response.code": "http_code",
    "outcome": "status", "result": "status", "eventid": "record_uid", "logontype": "logon_type", "mfa": "is_mfa",
}


def resolve(field: str, schema: T.StructType | None = None) -> str:
    """The normalized column of a field name, whatever its case; a column of the data's own keeps its name."""
    return field if schema is not None and field in schema.names else ALIASES.get(field.lower(), field)


def literal(value: str) -> str | None:
    """The text of a value without unescaped globs, its escapes removed; None if it has a glob."""
    return None if re.search(r"(?<!\\)(?:\\\\)*[*?]", value) else re.sub(r"\\([*?\\])", r"\1", value)


def glob_regex(value: str, cased: bool = False) -> str:
    """An anchored Java regex of a glob value."""
    out = []
    for m in re.finditer(r"\\([*?\\])|([*?])|(.)", value, re.S):
        out.append(".*" if m[2] == "*" else "." if m[2] == "?" else re.escape(m[1] or m[3]))
    return f"(?s{'' if cased else 'i'})^{''.join(out)}$"


def base64_offsets(text: bytes) -> list[str]:
    """The three forms that a text takes inside longer base64, without the characters its neighbours share."""
    forms = []
    for skip in range(3):
        whole = base64.b64encode(b" " * skip + text).decode()
        # Characters that hold bits of the bytes before, and (with padding) of the bytes after.
        before, after = (0, 2, 3)[skip], (0, 3, 2)[(len(text) + skip) % 3]
        forms.append(whole[before : len(whole) - after])
    return forms


def expand(values: Sequence, mods: Sequence[str]) -> list:
    """Values after encoding and dash modifiers."""
    out = list(values)
    if "windash" in mods:
        out = [v.replace("-", d, 1) if v.startswith("-") else v.replace(" -", f" {d}") for v in out for d in DASHES]
    coded = next((ENCODINGS[m] for m in mods if m in ENCODINGS), "utf-8")
    if "base64offset" in mods:
        out = [form for v in out for form in base64_offsets(str(v).encode(coded))]
    elif "base64" in mods:
        out = [base64.b64encode(str(v).encode(coded)).decode() for v in out]
    return list(dict.fromkeys(out))


def in_network(address: Column, network: str) -> Column:
    """Whether an address lies in a network; what isn't an address lies in none."""
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        return ipv4(address).between(int(net.network_address), int(net.broadcast_address))
    return ipv6(address).between(bytearray(net.network_address.packed), bytearray(net.broadcast_address.packed))


def one_value(c: Column, value, mods: Sequence[str]) -> Column:
    """Match of a scalar column against one value."""
    text = c.cast("string")
    if value is None:
        return c.isNull()
    if "re" in mods:
        flags = "".join(f for f in FLAGS if f in mods)
        return text.rlike(f"(?{flags}){value}" if flags else value)
    if "cidr" in mods:
        return in_network(text, value)
    if (op := next((m for m in mods if m in COMPARE), None)) is not None:
        return COMPARE[op](text.try_cast("double"), float(value))
    if isinstance(value, bool):
        low = F.lower(F.trim(text))
        return low.isin(*TRUE) if value else low.isin(*FALSE)
    if isinstance(value, (int, float)):
        return text.try_cast("double") == float(value)
    cased = "cased" in mods or "base64" in mods or "base64offset" in mods
    plain = literal(value)
    if plain is None:
        pattern = value
        if "contains" in mods or "endswith" in mods:
            pattern = "*" + pattern
        if "contains" in mods or "startswith" in mods:
            pattern += "*"
        return text.rlike(glob_regex(pattern, cased))
    left, right = (text, plain) if cased else (F.lower(text), plain.lower())
    if "contains" in mods or "base64" in mods or "base64offset" in mods:
        return left.contains(right)
    if "startswith" in mods:
        return left.startswith(right)
    if "endswith" in mods:
        return left.endswith(right)
    return left == right


def predicate(schema: T.StructType, field: str, values: Sequence = (), mods: Sequence[str] = ()) -> Column:
    """Two-valued match of a field against its values."""
    name = resolve(field, schema)
    # A field that the data doesn't have is null in every row.
    c, array = (F.col(name), isinstance(schema[name].dataType, T.ArrayType)) if name in schema.names else (F.lit(None).cast("string"), False)
    if "exists" in mods:
        there = F.size(F.filter(c, lambda x: x.isNotNull())) > 0 if array else c.isNotNull()
        there = F.coalesce(there, F.lit(False))
        return there if values[0] else ~there
    if "fieldref" in mods:
        other = [o for o in (resolve(v, schema) for v in values) if o in schema.names and name in schema.names]
        if len(other) < len(values):
            return F.lit(False)
        pairs = [F.arrays_overlap(*(F.transform(F.col(n), F.lower) if isinstance(schema[n].dataType, T.ArrayType) else F.array(F.lower(F.col(n).cast("string"))) for n in (name, o))) for o in other]
        return F.coalesce(reduce(and_ if "all" in mods else or_, pairs), F.lit(False))
    expanded = expand(values, mods)

    def test(value) -> Column:
        if not array:
            p = one_value(c, value, mods)
        elif value is None:
            p = c.isNull() | (F.size(F.filter(c, lambda x: x.isNotNull())) == 0)
        else:
            p = F.exists(c, lambda x: F.coalesce(one_value(x, value, mods), F.lit(False)))
        return F.coalesce(p, F.lit(False))

    return reduce(and_ if "all" in mods else or_, map(test, expanded))


def keyword(schema: T.StructType, words: Sequence[str]) -> Column:
    """Whether any scalar value of the row holds one of the words."""
    scalars = [F.col(f.name).cast("string") for f in schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    arrays = [F.array_join(f.name, "\n") for f in schema if isinstance(f.dataType, T.ArrayType)]
    whole = F.lower(F.concat_ws("\n", *scalars, *arrays))
    return reduce(or_, (whole.contains(w.lower()) for w in words))


def search(schema: T.StructType, groups: Sequence[dict]) -> Column:
    """A named search: groups are alternatives, the fields of a group must all match; ``field|mod|mod``: value(s)."""
    parts = []
    for group in groups:
        own = []
        for name, values in group.items():
            field, *mods = name.split("|")
            own.append(predicate(schema, field, values if isinstance(values, (list, tuple)) else [values], mods))
        parts.append(reduce(and_, own))
    return reduce(or_, parts)


def with_condition(df: DataFrame, searches: dict[str, Column], text: str | Sequence[str], name: str = "matched") -> DataFrame:
    """Adds column ``name``: a boolean expression over named searches, read by Spark's expression parser.

    ``1 of x*`` and ``all of x*`` (or ``them``) stand for any and all of the searches so named; a list of expressions means any.
    """
    texts = [text] if isinstance(text, str) else list(text)

    def counted(m: re.Match) -> str:
        chosen = [n for n in searches if m[2] == "them" or re.fullmatch(m[2].replace("*", ".*"), n)]
        if not chosen:
            raise ValueError(f"no search is called {m[2]}")
        return f"({(' OR ' if m[1] == '1' else ' AND ').join(chosen)})"

    whole = " OR ".join(f"({re.sub(r'(1|all) of (them|[*]|[A-Za-z_][*A-Za-z0-9_]*)', counted, t)})" for t in texts)
    return df.withColumns(searches).withColumn(name, F.expr(whole)).drop(*searches)
