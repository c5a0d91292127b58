"""Versions, ranges and advisories against plain Python."""

import random
import re
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from secflow.functions import versions as V
from secflow.operators import supply_chain
from secflow.operators.ranges import pairs, points_in_intervals, running
from secflow.plans import catalog
from secflow.plans.views import view

RANKS = {"dev": -5, "alpha": -4, "a": -4, "beta": -3, "b": -3, "rc": -2, "pre": -2, "preview": -2, "snapshot": -2}


def parts(text):
    return [(0, int(x), "") if x.isdigit() else (RANKS.get(x, 1), 0, x) for x in re.findall("[0-9]+|[a-z]+", text)]


def order(one, two):
    def lists(v):
        release, _, pre = v.lower().strip().lstrip("v").split("+")[0].partition("-")
        return parts(release), parts(pre)

    def longest(a, b):
        size = max(len(a), len(b))
        a, b = (x + [(0, 0, "")] * (size - len(x)) for x in (a, b))
        return (a > b) - (a < b)

    (r1, p1), (r2, p2) = lists(one), lists(two)
    return longest(r1, r2) or (bool(p2) - bool(p1) if bool(p1) != bool(p2) else longest(p1, p2))


VERSIONS = ["0", "1", "1.0", "1.0.0", "v1.0", "1.0a1", "1.0.0.dev3", "1.0.0.0.0.0.0.1", "1.2.3.4.5.6.7", "1.2.3.4.5.6.8", "1.0-rc1", "1.0-rc.2", "1.0-alpha", "1.0-a", "1.0-zz", "1.0+build", "0.2.0", "0.9.0", "0.0.1", "2.0.0-rc1", "2", "10.0", "9.99", "1.99999999999999999999999", "2024.01.02", "1.0.final", "1.0.post1", "", "-", "1.0-0"]


def test_order_of_versions(spark):
    pairs = spark.createDataFrame([(a, b) for a in VERSIONS for b in VERSIONS], "a string, b string")
    x, y = V.version_key(F.col("a")), V.version_key(F.col("b"))
    got = pairs.select("a", "b", F.when(x < y, -1).when(x > y, 1).otherwise(0).alias("o"), (x == y).alias("e")).collect()
    assert [(r.a, r.b, r.o) for r in got] == [(r.a, r.b, order(r.a, r.b)) for r in got]
    assert all(r.e == (r.o == 0) for r in got)


@pytest.mark.parametrize(
    "version,spec,inside",
    [
        ("2.4.1", ">=2.4.0 <2.4.2", True), ("2.4.2", ">=2.4.0 <2.4.2", False), ("2.4.0-rc1", ">=2.4.0 <2.4.2", False), ("1", None, True), ("1", " ", True), ("1", "any", True), ("1", "*", True), ("1", ">=1, *", True),
        (None, None, False), ("", "*", False), ("0.9.0", "^0.2.0", True), ("1.0.0", "^0.2.0", False), ("0.1.9", "^0.2.0", False), ("1.0.0-rc1", "^0.2.0", False), ("1.4.9", "~>1.4.2", True), ("1.5", "~>1.4.2", False), ("1.4.1", "~>1.4.2", False),
        ("0.4.7", "~>0.4", True), ("0.5.0-dev", "~>0.4", False), ("1.0", "1.0.0", True), ("1.0", "==1", True), ("1.0", "!=1", False), ("1.1", "!=1", True), ("1.2.3.4.5.6.8", ">1.2.3.4.5.6.7", True), ("3", ">=2 <3", False), ("2.9", ">= 2 < 3", True),
    ],
)
def test_ranges(spark, version, spec, inside):
    one = spark.createDataFrame([(version, spec)], "v string, s string")
    assert one.select(V.in_range(F.col("v"), F.col("s"))).first()[0] is inside


@pytest.mark.parametrize("version,fixed,done", [("1.0", None, False), ("1.0", "", False), (None, "1.0", False), ("", "1.0", False), ("1.0", "1.0.0", True), ("1.0-rc1", "1.0", False), ("2", "1.5", True)])
def test_published_fixes(spark, version, fixed, done):
    one = spark.createDataFrame([(version, fixed)], "v string, f string")
    assert one.select(V.is_fixed(F.col("v"), F.col("f"))).first()[0] is done


def test_advisories(spark):
    """An advisory without a fix stays open, one without a range holds all versions below its fix."""
    components = spark.createDataFrame([(1, "p", "npm", "1.0"), (2, "p", "npm", "2.0"), (3, "p", "pypi", "1.0"), (4, "p", "npm", None), (5, "p", "npm", ""), (6, "q", None, "1.0"), (7, "p", "npm", "1.0")], "id int, package string, ecosystem string, version string")
    advisories = spark.createDataFrame([("nofix", "p", "npm", "<2.0", None), ("norange", "p", None, None, "2.0"), ("both", "p", "npm", None, ""), ("eco", "q", "npm", "*", None), ("all", "q", None, "any", None), ("none", "p", "npm", ">=3", None)], "vuln_id string, package string, ecosystem string, affected string, fixed string")
    got = {(r.id, r.vuln_id) for r in supply_chain.match_advisories(components, advisories).collect()}
    assert got == {(1, "nofix"), (7, "nofix"), (1, "norange"), (3, "norange"), (7, "norange"), (1, "both"), (2, "both"), (7, "both"), (6, "all")}
    found = supply_chain.match_advisories(components, advisories).select("id", "version", "vuln_id")
    now = advisories.withColumn("fixed", F.when(F.col("vuln_id") == "nofix", "1.0").otherwise(F.col("fixed"))).withColumn("affected", F.when(F.col("vuln_id") == "both", ">=2").otherwise(F.col("affected")))
    status = {(r.id, r.vuln_id): r.status for r in supply_chain.rematch(found, now).collect()}
    assert status[1, "nofix"] == "fixed" and status[1, "both"] == "not_affected" and status[2, "both"] == "affected" and status[3, "norange"] == "affected"
    assert supply_chain.match_advisories(components.limit(0), advisories).count() == supply_chain.match_advisories(components, advisories.limit(0)).count() == 0


def test_advisories_of_the_views(spark):
    """All pairs of a package, from the tables themselves."""
    c, a = (view(spark, "/root/testdata/sf0.001", v) for v in ("v_components", "v_advisories"))
    same = lambda v, t, n: [(parts(v.split("-")[0]) + [(0, 0, "")] * 3)[i] == (parts(t) + [(0, 0, "")] * 3)[i] for i in range(n)]

    def meets(v, part):
        op, t = re.match("(>=|<=|!=|~>|[<>^])?(.*)", part).groups()
        o = order(v, t)
        return {">=": o >= 0, "<=": o <= 0, "!=": o != 0, "<": o < 0, ">": o > 0, "^": o >= 0 and all(same(v, t, 1)), "~>": o >= 0 and all(same(v, t, 2))}[op]

    want, advisories = set(), a.collect()
    for x in c.collect():
        for y in advisories:
            asked = [] if y.affected is None or y.affected.strip() in ("", "any") else re.split("[, ]+", y.affected)
            if x.package == y.package and y.ecosystem in (None, x.ecosystem) and all(meets(x.version, p) for p in asked) and not (y.fixed and order(x.version, y.fixed) >= 0):
                want.add((x.part_id, y.vuln_id))
    got = supply_chain.match_advisories(c, a).select("part_id", "vuln_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_states_of_all_advisories(spark):
    """Every advisory on a component's package, whether it affects it, is fixed there or doesn't reach it."""
    components = spark.createDataFrame([(1, "p", "npm", "1.0"), (2, "p", "npm", "2.0"), (3, "p", "pypi", "1.0"), (4, "p", "npm", None), (5, "p", "npm", " "), (6, "q", None, "1.0"), (7, "p", "npm", "1.0"), (8, None, "npm", "1.0"), (9, "r", "npm", "1.0")], "id int, package string, ecosystem string, version string")
    advisories = spark.createDataFrame([("low", "p", "npm", "<2.0", None), ("fix", "p", None, None, "2.0"), ("late", "p", "npm", ">=3", ""), ("out", "p", "npm", ">=3", "1.0"), ("eco", "q", "npm", "*", None), ("all", "q", "", "any", "0.9"), ("none", None, None, "*", None)], "vuln_id string, package string, ecosystem string, affected string, fixed string")
    got = sorted((r.id, r.vuln_id, r.status) for r in supply_chain.advisory_states(components, advisories).collect())
    want = {"low": {1: "affected", 7: "affected"}, "fix": {1: "affected", 2: "fixed", 3: "affected", 7: "affected"}, "late": {}, "out": {1: "fixed", 2: "fixed", 7: "fixed"}}
    pairs = [(i, v, states.get(i, "not_affected")) for v, states in want.items() for i in ((1, 2, 3, 4, 5, 7) if v == "fix" else (1, 2, 4, 5, 7))]
    assert got == sorted([*pairs, (6, "all", "fixed")])
    met = {(i, v) for i, v, status in got if status == "affected"}
    assert met == {(r.id, r.vuln_id) for r in supply_chain.match_advisories(components, advisories).collect()}
    assert supply_chain.advisory_states(components.limit(0), advisories).count() == supply_chain.advisory_states(components, advisories.limit(0)).count() == 0


def test_match_query_leaves_no_pair_out(spark):
    """Each component once with each advisory on its package and ecosystem: as many rows as the tables have such pairs."""
    c, a = (view(spark, "/root/testdata/sf0.001", v) for v in ("v_components", "v_advisories"))
    of = {}
    for y in a.collect():
        of.setdefault(y.package, []).append(y)
    want = {}
    for x in c.collect():
        for y in of.get(x.package, []):
            if y.ecosystem in (None, x.ecosystem):
                want[x.part_id, y.vuln_id] = bool(y.fixed) and order(x.version, y.fixed) >= 0
    got = catalog.queries()["sbom_match"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want) and {(r.part_id, r.vuln_id): r.status == "fixed" for r in got} == want
    assert {r.status for r in got} == {"affected", "fixed", "not_affected"}
    assert {(r.part_id, r.vuln_id) for r in got if r.status == "affected"} == {tuple(r) for r in supply_chain.match_advisories(c, a).select("part_id", "vuln_id").collect()}


def test_points_in_intervals(spark):
    rnd = random.Random(5)
    points = [(g, p) for g in "ab" for p in sorted(rnd.sample(range(200), 70))]
    end = lambda p, side: None if p is None else (p, side)
    intervals = [(g, i, end(lo, rnd.choice((-1, 1))), end(hi, rnd.choice((-1, 1)))) for i, (g, lo, hi) in enumerate((rnd.choice("abc"), rnd.choice((None, *range(0, 200, 7))), rnd.choice((None, *range(0, 200, 9)))) for _ in range(80))]
    inside = lambda p, lo, hi: (lo is None or lo < (p, 0)) and (hi is None or (p, 0) < hi)
    want = sorted((g, p, i) for g, p in points for h, i, lo, hi in intervals if g == h and inside(p, lo, hi))
    kind = "g string, id int, low struct<key:int,side:int>, high struct<key:int,side:int>"
    got = points_in_intervals(spark.createDataFrame(points, "g string, p int"), spark.createDataFrame(intervals, kind), ["g"], "p", "low", "high")
    assert sorted((r.g, r.p, r.id) for r in got.collect()) == want


def test_pairs_of_large_keys_spread(spark):
    """All pairs of a key, copies of rows too; a key with many rows isn't one task's."""
    rnd = random.Random(7)
    left = [(rnd.choice("aaaab") if i % 9 else None, i // 2) for i in range(90)]
    right = [(rnd.choice("aabc") if i % 7 else None, i // 3) for i in range(60)]
    want = sorted((g, x, y) for g, x in left for h, y in right if g is not None and g == h)
    sides = spark.createDataFrame(left, "g string, x int"), spark.createDataFrame(right, "g string, y int")
    assert sorted(tuple(r) for r in pairs(*sides, ["g"], size=1000).collect()) == want
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        tasks = {size: pairs(*sides, ["g"], size=size).withColumn("task", F.spark_partition_id()).collect() for size in (4, 1000)}
    finally:
        for name in plain:
            spark.conf.unset(name)
    spread = tasks[4]
    assert sorted((r.g, r.x, r.y) for r in spread) == want
    assert len({r.task for r in tasks[1000] if r.g == "a"}) == 1 < len({r.task for r in spread if r.g == "a"})


def test_running_totals(spark):
    rows = [(None if i % 3 == 0 else "g", i * 7919 % 500, i % 5) for i in range(500)]
    got = running(spark.createDataFrame(rows, "g string, t int, n int"), ["g"], ["t"], total=F.col("n"), rows=F.lit(1)).collect()
    for g in (None, "g"):
        own, total = sorted((t, n) for h, t, n in rows if h == g), 0
        for r, (i, (t, n)) in zip(sorted((r for r in got if r.g == g), key=lambda r: r.t), enumerate(own), strict=True):
            assert (r.t, r.total, r.rows) == (t, total, i)
            total += n


def test_documents(spark):
    import json

    bom = {"bomFormat": "CycloneDX", "components": [{"name": "one", "version": "1", "type": "Library", "licenses": [{"license": {"id": "MIT"}}, {"license": {"name": "Own"}}, {"expression": "A OR B"}, {}]}, {"name": "", "version": "2"}, {"version": "3"}, {"name": "two", "purl": ""}]}
    got = {r.name: (r.purl, r.licenses) for r in supply_chain.from_cyclonedx(spark.createDataFrame([(json.dumps(bom),)], "document string")).collect()}
    assert got == {"one": ("pkg:library/one@1", ["MIT", "Own", "A OR B"]), "two": ("pkg:generic/two", [])}
    spdx = {"spdxVersion": "SPDX-2.3", "name": "app", "packages": [{"SPDXID": "1", "name": "x", "licenseConcluded": "NOASSERTION", "licenseDeclared": "MIT"}, {"SPDXID": "2"}]}
    got = supply_chain.from_spdx(spark.createDataFrame([(json.dumps(spdx),)], "document string")).collect()
    assert [(r.name, r.purl, r.licenses) for r in got] == [("x", "pkg:generic/x", ["MIT"])]


assert sorted(VERSIONS, key=cmp_to_key(order))
