"""Risk scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from secflow.functions.predicates import in_network
from secflow.schema import LEVELS

#: Lower bounds of the risk bands.
BANDS = ((90, "critical"), (70, "high"), (50, "medium"), (30, "low"), (0, "informational"))
#: Weights of context signals, the clamp of their product, the most points they add.
WEIGHTS = {
    "external_source": 1.10, "known_malicious_indicator": 1.30, "anonymizing_infrastructure": 1.20, "no_mfa": 1.10, "off_hours": 1.05, "privileged_target": 1.15,
    "critical_asset_touched": 1.15, "first_seen_source": 1.10, "service_account": 0.85, "load_test_account": 0.40, "known_maintenance_window": 0.70,
}
FLOOR, CEILING, MOST_POINTS = 0.35, 1.60, 25.0
#: Incident bonuses for further rules, further tactics, an intel hit, a complete scenario.
PER_RULE, PER_TACTIC, FOR_INTEL, FOR_COMPLETE = 6, 5, 8, 10


def band(score: Column) -> Column:
    """Name of the score's band."""
    found = F.when(F.lit(False), F.lit(""))
    for low, name in BANDS:
        found = found.when(score >= low, name)
    return found.otherwise("informational")


def level_severity(level: Column) -> Column:
    """Severity of a rule level; an unknown level counts as medium."""
    found = F.when(F.lit(False), F.lit(0))
    for name, value in LEVELS.items():
        found = found.when(F.lower(level) == name, value)
    return found.otherwise(LEVELS["medium"])


def signals(*, source_ip: Column, internal: list[str], verdict: Column, class_uid: Column, status_id: Column, is_mfa: Column, time: Column, privileged: Column, critical: Column, service: Column, load_test: Column, first_seen: Column | None = None, maintenance: Column | None = None) -> Column:
    """Names of the context signals that hold, as an array in a fixed order."""
    is_internal = F.lit(False)
    for network in internal:
        is_internal = is_internal | F.coalesce(in_network(source_ip, network), F.lit(False))
    hour = F.hour(time)
    tests = {
        "external_source": source_ip.isNotNull() & ~is_internal,
        "known_malicious_indicator": verdict.isin("malicious", "known_bad"),
        "anonymizing_infrastructure": verdict.isin("anonymizer", "tor", "proxy", "vpn"),
        "no_mfa": (class_uid == 3002) & (status_id != 2) & (is_mfa == False),  # noqa: E712
        "off_hours": (hour < 6) | (hour >= 22) | (F.weekday(time) >= 5),
        "privileged_target": privileged,
        "critical_asset_touched": critical,
        "first_seen_source": F.lit(False) if first_seen is None else first_seen,
        "service_account": service,
        "load_test_account": load_test,
        "known_maintenance_window": F.lit(False) if maintenance is None else maintenance,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))


#: Signals that by themselves say an alert is almost surely benign.
SUPPRESSING = ("load_test_account", "known_maintenance_window")


def suppressing(names: Column) -> Column:
    """Those of the signals that silence an alert, in their fixed order."""
    return F.filter(F.array(*map(F.lit, SUPPRESSING)), lambda n: F.array_contains(names, n))


def modifier(names: Column) -> Column:
    """Product of the signals' weights, clamped."""
    weights = F.create_map(*(F.lit(x) for item in WEIGHTS.items() for x in item))
    return F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), F.aggregate(names, F.lit(1.0), lambda a, n: a * F.coalesce(weights[n], F.lit(1.0)))))


def alert_score(severity: Column, confidence: Column, criticality: Column, factor: Column) -> Column:
    """Geometric mean of three ratings, each held to 1..10, as a 0-100 base; a factor above 1 fills part of the headroom, one below damps. Halves round to even."""
    held = [F.greatest(F.lit(1), F.least(F.lit(10), x)) / 10 for x in (severity, confidence, criticality)]
    base = 100 * F.pow(held[0] * held[1] * held[2], F.lit(1.0 / 3.0))
    share = (factor - 1.0) / (CEILING - 1.0)
    raised = base + F.least((100.0 - base) * share, MOST_POINTS * share)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(F.when(factor >= 1.0, raised).otherwise(base * factor)))).cast("long")


def incident_score(top: Column, rules: Column, tactics: Column, intel: Column, complete: Column) -> Column:
    """The highest alert score, raised by bonuses that close part of the distance to 100."""
    bonus = PER_RULE * F.greatest(F.lit(0), rules - 1) + PER_TACTIC * F.greatest(F.lit(0), tactics - 1) + F.when(intel, FOR_INTEL).otherwise(0) + F.when(complete, FOR_COMPLETE).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(top + (100.0 - top) * bonus / 100.0))).cast("long")
