"""Operators on small inputs of their own: what the registered queries' tables don't show."""

import json

import pytest
from pyspark.sql import functions as F

from secflow.operators import correlate, enrich, incidents, normalize, supply_chain, windows
from secflow.sources import sinks

HOUR = 3600


def test_networks_of_both_versions(spark):
    values = [("10.1.2.3",), ("10.200.0.1",), ("2001:db8::1",), ("2001:db8:0:ffff::9",), ("2001:DB9::1",), ("::1",), ("fe80::1",), ("no address",), (None,)]
    nets = [("10.0.0.0/8", "benign", 1, 3), ("10.1.0.0/16", "suspicious", 2, 1), ("2001:db8::/32", "benign", 3, 2), ("2001:db8::/64", "malicious", 4, 0), ("fe80::/9", "benign", 5, 5), ("::1/128", "benign", 6, 6), ("nonsense/8", "benign", 7, 7)]
    got = enrich.match_networks(spark.createDataFrame(values, "value string"), spark.createDataFrame(nets, "cidr string, verdict string, score int, ordinal int"))
    assert {r.value: r.cidr for r in got.collect()} == {"10.1.2.3": "10.1.0.0/16", "10.200.0.1": "10.0.0.0/8", "2001:db8::1": "2001:db8::/64", "2001:db8:0:ffff::9": "2001:db8::/32", "::1": "::1/128", "fe80::1": "fe80::/9"}


def test_networks_against_the_standard_library(spark):
    import ipaddress
    import random

    rnd = random.Random(4)
    ip4 = [str(ipaddress.IPv4Address(rnd.getrandbits(32) & 0xFF0300FF)) for _ in range(60)]
    ip6 = [str(ipaddress.IPv6Address((0x20010DB8 << 96) | (rnd.getrandbits(96) & rnd.choice([0xFF, 0xF << 80, 0x3F << 33])))) for _ in range(60)]
    odd = ["::", "::1", "1::", "::ffff:10.1.2.3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2", ":::", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "g::", "256.1.1.1", "01.2.3.4", "", None, "ABCD::EF"]
    nets = ["0.0.0.0/0", "::/0"] + [f"{a}/{rnd.randrange(33)}" for a in ip4[:25]] + [f"{a}/{rnd.randrange(129)}" for a in ip6[:25]] + ["10.0.0.0/33", "x/8", "::/129", "1.2.3.4"]
    known = [(i, n, ipaddress.ip_network(n, strict=False)) for i, n in enumerate(nets) if not n.endswith(("/33", "x/8", "/129"))]
    want = {}
    for a in ip4 + ip6 + odd:
        try:
            at = ipaddress.ip_address(a)
        except ValueError:
            continue
        found = [n for _, n, net in sorted(known, key=lambda k: -k[0]) if net.version == at.version and at in net]
        if found:
            want[a] = found[0]
    rows = [(n, "benign", 1, -i) for i, n in enumerate(nets)]
    got = enrich.match_networks(spark.createDataFrame([(a,) for a in ip4 + ip6 + odd], "value string"), spark.createDataFrame(rows, "cidr string, verdict string, score int, ordinal int"))
    assert {r.value: r.cidr for r in got.collect()} == want


def test_patterns_in_several_steps(spark, monkeypatch):
    monkeypatch.setattr(enrich, "GLOBS", 2)
    rows = [("db-*", "high"), ("web-?", "low"), ("db-7", "critical"), ("x*", "low"), ("*", "medium")]
    values = spark.createDataFrame([("DB-7",), ("db-70",), ("web-1",), ("web-10",), ("xy",), (None,)], "value string")
    got = {r.value: r.level for r in enrich.first_pattern(values, enrich.pattern_table(values, rows)).collect()}
    assert got == {"DB-7": "critical", "db-70": "high", "web-1": "low", "web-10": "medium", "xy": "low"}


def test_chains_of_rules(spark):
    """Order counts, equal times fall to the id, a beginning may fall out of the window."""
    rows = [("a", 1, 0, "x"), ("a", 2, 10, "y"), ("a", 3, 20, "z"), ("b", 4, 0, "y"), ("b", 5, 10, "x"), ("b", 6, 20, "z"), ("c", 7, 0, "x"), ("c", 8, 90, "y"), ("c", 9, 150, "z"), ("d", 10, 5, "x"), ("d", 11, 5, "y"), ("d", 12, 5, "z"), ("e", 13, 0, "x"), ("e", 14, 50, "x"), ("e", 15, 60, "y"), ("e", 16, 140, "z")]
    alerts = spark.createDataFrame([(k, i, t * windows.SECOND, r) for k, i, t, r in rows], "key string, id long, t long, rule_id string")
    seen = correlate.in_window(alerts, ["key"], 100, ["x", "y", "z"])
    assert {r.id for r in correlate.temporal_ordered(seen).collect()} == {3, 10, 11, 12, 16}
    assert {r.id for r in correlate.temporal(seen).collect()} == {3, 6, 10, 11, 12, 16}
    assert {(r.id, r.observed, r.first_seen) for r in seen.where("key = 'e'").collect()} == {(13, 1, 0), (14, 2, 0), (15, 3, 0), (16, 3, 50 * windows.SECOND)}


def test_silence_by_runs(spark):
    times = [0, 0, 5, 9, 10, 19, 20, 21, 100, 109, 110]
    df = spark.createDataFrame([("k", t * windows.SECOND, i) for i, t in enumerate(times)], "key string, t long, event_id long")
    assert sorted(r.event_id for r in windows.suppress(df, ["key"], 10, ["event_id"]).collect()) == [0, 4, 6, 8, 10]


def test_no_routing_rules(spark):
    kind = "rule string, priority int, team int, severities array<string>, pattern string, min_risk int, max_risk int"
    one = spark.createDataFrame([(1, "high", None, 50)], "id long, severity string, principal string, risk_score int")
    assert [tuple(r) for r in incidents.first_route(one, spark.createDataFrame([], kind)).collect()] == [(1, None, None)]
    rules = spark.createDataFrame([("r1", 2, 7, None, None, None, None), ("r0", 1, 8, None, "^a", None, None)], kind)
    assert [tuple(r) for r in incidents.first_route(one, rules).collect()] == [(1, "r1", 7)]


def test_direct_components(spark):
    part = lambda n: {"name": n, "version": "1", "bom-ref": n}
    told = {"bomFormat": "CycloneDX", "metadata": {"component": {"name": "app", "bom-ref": "root"}}, "components": [part("one"), part("two")], "dependencies": [{"ref": "root", "dependsOn": ["two"]}]}
    silent = {k: v for k, v in told.items() if k != "dependencies"}
    docs = spark.createDataFrame([(1, json.dumps(told)), (2, json.dumps(silent))], "id int, document string")
    assert {(r.id, r.name): r.direct for r in supply_chain.from_cyclonedx(docs).collect()} == {(1, "one"): False, (1, "two"): True, (2, "one"): True, (2, "two"): True}
    spdx = {"spdxVersion": "SPDX-2.3", "name": "app", "documentDescribes": ["root"], "packages": [{"SPDXID": "root", "name": "app"}, *({"SPDXID": str(p), "name": str(p), "primaryPackagePurpose": p} for p in (None, "LIBRARY", "SOURCE"))]}
    got = supply_chain.from_spdx(spark.createDataFrame([(json.dumps(spdx),)], "document string")).collect()
    assert {r.name: r.direct for r in got} == {"None": True, "LIBRARY": True, "SOURCE": False}


def test_sink_keeps_the_first_and_fails_on_a_broken_table(spark, tmp_path):
    batch = spark.createDataFrame([("t", "k", 5, 2), ("t", "k", 5, 1), ("t", "l", 6, 3)], "tenant string, dedup_key string, t long, event_id long")
    path = f"file://{tmp_path}/events"
    assert sinks.write_events(batch, path) == {"indexed": 2, "duplicates": 1}
    assert sinks.write_events(batch, path) == {"indexed": 0, "duplicates": 3}
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == [1, 3]
    spark.range(1).withColumn("event_date", F.lit("x")).write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="dedup_key"):
        sinks.write_events(batch, path)


def test_leaves_of_nested_columns(spark):
    kind = "e struct<who: struct<name: string, id: int>, items: array<struct<uid: string, marks: array<string>>>, tags: array<string>, rest: map<string, string>, none: struct<x: string>>"
    full = ((("eve", 7), [("a", ["m", "n"]), None, (None, None)], ["t", None, "u"], {"k": "v", "z": None}, None),)
    df = spark.createDataFrame([full, (None,)], kind)
    got = [sorted(map(tuple, r.l)) for r in df.select(normalize.flat(F.col("e"), df.schema["e"].dataType).alias("l")).collect()]
    assert got == [[("items[0].marks", "m"), ("items[0].marks", "n"), ("items[0].uid", "a"), ("rest.k", "v"), ("tags", "t"), ("tags", "u"), ("who.id", "7"), ("who.name", "eve")], []]


def test_globs_against_plain_python(spark):
    """Heads, tails and globs with neither, in any case, first by order; null and empty values, no patterns."""
    import random
    import re

    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abAB-") for _ in range(n))
    values = [word(rnd.randrange(1, 7)) for _ in range(150)] + ["", None, "a*b", "x\\y", "\u00c9tage"]
    forms = [lambda: word(2) + "*", lambda: "*" + word(2), lambda: "*" + word(1) + "*", lambda: word(1) + "?" + word(1), lambda: "?" * rnd.randrange(1, 4), lambda: word(3), lambda: word(1) + "*" + word(1)]
    rows = [(rnd.choice(forms)(), f"l{i}") for i in range(80)] + [("a\\*b", "escaped"), ("x\\\\*", "slash"), ("\u00e9t*", "accent"), ("zz*", None)]
    table = enrich.pattern_table(spark.createDataFrame([(1,)], "a int"), rows)
    regexes = [(p.lower(), re.compile(r.regex.replace("(?si)", ""), re.S | re.I | re.A), level) for (p, level), r in zip(rows, table.orderBy("ordinal").collect(), strict=True)]
    want = {}
    for v in {v for v in values if v is not None}:
        low = v.lower()
        found = next((level for p, _, level in regexes if p == low), None) or next((level for (p, r, level) in regexes if re.search("[*?]", p) and level and r.search(low)), None)
        if found:
            want[v] = found
    got = [tuple(r) for r in enrich.first_pattern(spark.createDataFrame([(v,) for v in values], "value string"), table).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert enrich.first_pattern(spark.createDataFrame([("a",)], "value string"), table.limit(0)).count() == 0
