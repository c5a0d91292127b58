"""Searches over normalized events: row filters as Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.functions.predicates import glob_regex

#: Log source categories and the event classes that they cover.
CATEGORIES = {"authentication": (3002,), "account": (3001, 3005), "account_change": (3001,), "process_creation": (1007,), "file_event": (1001,), "api": (6003,), "datastore": (6005,), "http": (4002,), "group": (3006,)}


def logsource(category: str | None = None, product: str | None = None, service: str | None = None) -> Column:
    """Rows of a log source; equality on plain columns, so it is pushed down to Parquet."""
    parts = [F.col("class_uid").isin(*CATEGORIES[category])] if category else []
    parts += [F.col(n) == v for n, v in (("product", product), ("service", service)) if v]
    return reduce(and_, parts, F.lit(True))


def tenant_rows(df: DataFrame, tenant: str, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted ids that exist, and whether they belong to another tenant only."""
    held = df.join(wanted, key, "left_semi")
    return held.groupBy(key).agg((F.max((F.col("tenant") == tenant).cast("int")) == 0).alias("elsewhere"))


def event_search(*, tenant: str | None = None, classes: Sequence[int] = (), principal: str | None = None, source_ip: str | None = None, hostname: str | None = None, session: str | None = None, status_id: int | None = None, min_severity: int | None = None, ids: Sequence = (), start: int | None = None, end: int | None = None) -> Column:
    """A conjunction of what is asked for; ``start`` and ``end`` are microseconds, the end excluded."""
    parts: list[Column] = []
    for name, value in (("tenant", tenant), ("source_ip", source_ip), ("hostname", hostname), ("session_uid", session), ("status_id", status_id)):
        if value is not None:
            parts.append(F.col(name) == value)
    if classes:
        parts.append(F.col("class_uid").isin(*classes))
    if principal is not None:
        parts.append(reduce(or_, (F.coalesce(F.lower(c) == principal.lower(), F.lit(False)) for c in ("principal", "target_principal"))))
    if min_severity is not None:
        parts.append(F.col("severity_id") >= min_severity)
    if ids:
        parts.append(F.col("event_id").isin(*ids))
    if start is not None:
        parts.append(F.col("t") >= start)
    if end is not None:
        parts.append(F.col("t") < end)
    return reduce(and_, parts, F.lit(True))


def full_text(schema: T.StructType, text: str) -> Column:
    """Case-insensitive substring of the row's document."""
    whole = F.to_json(F.struct(*schema.names))
    return F.lower(whole).contains(text.lower())


def filter_spec(spec: dict) -> Column:
    """A filter given as data: bool, term, terms, wildcard, prefix, regexp, range, exists. Null is no match."""
    kind, body = next(iter(spec.items()))
    if kind == "bool":
        parts = [filter_spec(s) for s in [*body.get("must", []), *body.get("filter", [])]]
        parts += [~filter_spec(s) for s in body.get("must_not", [])]
        if body.get("should"):
            parts.append(reduce(or_, map(filter_spec, body["should"])))
        return reduce(and_, parts, F.lit(True))
    name, value = next(iter(body.items()))
    c = F.col(value if kind == "exists" else name)
    if kind == "exists":
        found = c.isNotNull()
    elif kind == "term":
        found = c == value
    elif kind == "terms":
        found = c.isin(*value)
    elif kind == "prefix":
        found = c.startswith(value)
    elif kind == "wildcard":
        found = c.rlike(glob_regex(value))
    elif kind == "regexp":
        found = c.rlike(f"^(?:{value})$")
    else:
        ends = {"gte": lambda v: c >= v, "gt": lambda v: c > v, "lte": lambda v: c <= v, "lt": lambda v: c < v}
        found = reduce(and_, (ends[k](v) for k, v in value.items()))
    return F.coalesce(found, F.lit(False))
