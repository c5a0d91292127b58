"""Alert, incident, link and routing tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from secflow.functions.predicates import glob_regex
from secflow.operators import ranges

#: Severity order, risk at which a single alert opens an incident, first incident number.
SEVERITY_ORDER = ("informational", "low", "medium", "high", "critical")
OPENS_AT, FIRST_NUMBER = 70, 2001
#: The allowed status changes.
TRANSITIONS = {
    "new": ("triaged", "investigating", "closed"), "triaged": ("investigating", "waiting", "contained", "closed"), "investigating": ("waiting", "contained", "closed"),
    "waiting": ("investigating", "contained", "closed"), "contained": ("investigating", "closed"), "closed": ("investigating",),
}
SYMMETRIC = ("related",)
INVERSE = {"duplicate_of": "duplicated_by", "child_of": "parent_of", "related": "related"}
#: Least role for a status.
LEAST_ROLE = {"closed": "lead", "contained": "analyst", "investigating": "analyst", "triaged": "analyst", "waiting": "analyst", "new": "lead"}
ROLES = ("viewer", "analyst", "lead")


def upsert_alerts(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: occurrences summed, times widened, ids united, the row of highest risk gives level and factors."""
    both = stored.unionByName(fresh)
    best = F.struct("risk_score", "t", "id")
    return both.groupBy(*keys).agg(F.sum("occurrences").alias("occurrences"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.array_sort(F.collect_set("id")).alias("event_ids"), F.max("risk_score").alias("risk_score"), F.max_by("level", best).alias("level"))


def latest(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of a change log per key."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def numbered(df: DataFrame, tenant: str, order: list[str]) -> DataFrame:
    """Adds ``key``: INC-2001, INC-2002, ... in each tenant's order of creation."""
    placed = ranges.running(df, [tenant], order, _before=F.lit(1))
    return placed.withColumn("key", F.concat(F.lit("INC-"), (F.col("_before") + FIRST_NUMBER).cast("string"))).drop("_before")


def canonical_links(edges: DataFrame) -> DataFrame:
    """Edges without self-links and repeats; symmetric ones are stored with the smaller id first."""
    flip = F.col("kind").isin(*SYMMETRIC) & (F.col("a") > F.col("b"))
    own = edges.where("a <> b").select(F.when(flip, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("b"), "kind")
    return own.distinct()


def without_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between none of the pairs, in either direction."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    gone = pairs.select(low.alias("_low"), high.alias("_high")).distinct()
    return edges.join(gone, (F.least("a", "b") == F.col("_low")) & (F.greatest("a", "b") == F.col("_high")), "left_anti")


def link_view(edges: DataFrame) -> DataFrame:
    """Edges as seen from either end, with the relation's inverse on the far side."""
    inverse = F.create_map(*(F.lit(x) for item in INVERSE.items() for x in item))
    return edges.select(F.col("a").alias("incident"), F.col("b").alias("other"), F.col("kind").alias("relation")).unionByName(edges.select(F.col("b").alias("incident"), F.col("a").alias("other"), inverse[F.col("kind")].alias("relation")))


def rank_of(column: Column, order: tuple[str, ...]) -> Column:
    """Place of a label in an order, 0 first."""
    return F.array_position(F.array(*map(F.lit, order)), column) - 1


def transition_table(df: DataFrame) -> DataFrame:
    rows = [(a, b) for a, to in TRANSITIONS.items() for b in to]
    return df.sparkSession.createDataFrame(rows, "from_status string, to_status string")


#: Conditions of a routing rule and the fact of an incident that each asks about: lists of names, lists of globs.
LISTED = {"severities": "severity", "tenants": "tenant", "tactics": "tactics"}
GLOBBED = {"scenarios": "scenario", "techniques": "techniques", "rule_ids": "rule_ids", "principals": "principal", "hostnames": "hostnames", "source_ips": "source_ips"}
#: Rules of one expression; more are tried step after step.
AT_ONCE = 200


def incident_facts(incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """Incidents with what routing asks of their alerts: tactics, techniques, rule_ids, hostnames, source_ips."""
    names = {"tactic": "tactics", "technique": "techniques", "rule_id": "rule_ids", "hostname": "hostnames", "source_ip": "source_ips"}
    per = alerts.groupBy("incident_id").agg(*(F.array_sort(F.collect_set(c)).alias(n) for c, n in names.items()))
    return incidents.join(per.withColumnRenamed("incident_id", "id"), "id", "left")


def _fits(regex: str) -> Callable[[Column], Column]:
    return lambda x: (x != "") & x.rlike(regex)


def _holds(r: Row, kinds: dict[str, str]) -> Column:
    """Whether a rule's conditions hold; a condition that it doesn't name, or leaves null, holds."""
    asked = r.asDict()
    many = lambda fact: F.col(fact) if kinds[fact].startswith("array") else F.array(fact)
    tests = [F.coalesce(F.arrays_overlap(F.transform(many(fact), F.lower if name == "severities" else lambda x: x), F.array(*(F.lit(v.lower() if name == "severities" else v) for v in asked[name]))), F.lit(False)) for name, fact in LISTED.items() if asked.get(name) is not None]
    for name, fact in GLOBBED.items():
        if asked.get(name) is not None:
            regex = "|".join(f"(?:{glob_regex(g)})" for g in asked[name]) or "$^"
            tests.append(F.coalesce(F.exists(many(fact), _fits(regex)), F.lit(False)))
    if asked.get("pattern") is not None:
        tests.append(F.col("principal").rlike(asked["pattern"]))
    tests += [F.col("risk_score") >= asked["min_risk"]] if asked.get("min_risk") is not None else []
    tests += [F.col("risk_score") <= asked["max_risk"]] if asked.get("max_risk") is not None else []
    return F.coalesce(functools.reduce(lambda x, y: x & y, tests, F.lit(True)), F.lit(False))


def _conditions(incidents: DataFrame, rules: DataFrame) -> list[list[tuple[Column, Column]]]:
    """Each rule (a literal row) and whether its conditions hold, in order, some at a time; the rules are a dimension that people write."""
    found = [(F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["team"]).alias("team")), _holds(r, dict(incidents.dtypes))) for r in rules.orderBy("priority", "rule").collect()]
    return [found[i : i + AT_ONCE] for i in range(0, len(found), AT_ONCE)]


def routing(incidents: DataFrame, rules: DataFrame) -> DataFrame:
    """Every incident with every rule and whether its conditions hold, as an explanation asks for.

    A rule's null condition holds for all. ``severities``, ``tenants`` and ``tactics`` are
    lists; ``scenarios``, ``techniques``, ``rule_ids``, ``principals``, ``hostnames`` and
    ``source_ips`` lists of globs, whatever their case; ``pattern`` is a regex on the
    principal; ``min_risk`` and ``max_risk`` are limits.
    """
    out = incidents.withColumn("_r", F.array().cast("array<struct<rule:string,team:int,holds:boolean>>"))
    for part in _conditions(incidents, rules):
        out = out.withColumn("_r", F.concat("_r", F.array(*(F.struct(r["rule"].alias("rule"), r["team"].alias("team"), holds.alias("holds")) for r, holds in part))))
    return out.withColumn("_r", F.explode("_r")).select("*", "_r.*").drop("_r")


def first_route(incidents: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of lowest (priority, rule) that holds, per incident; null if none does. Projections only, no join and no shuffle."""
    kind = rules.select(F.struct("rule", "team")).schema[0].dataType
    out = incidents.withColumn("_r", F.lit(None).cast(kind))
    for part in _conditions(incidents, rules):
        out = out.withColumn("_r", F.coalesce("_r", *(F.when(holds, r) for r, holds in part)))
    return out.select("id", "_r.rule", "_r.team")
