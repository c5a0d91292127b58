"""Truth table of the predicate modifiers, and edge cases of the window operators."""

import base64

import pytest
from pyspark.sql import functions as F

from secflow.functions import predicates as P
from secflow.functions import risk
from secflow.functions.times import parse_time
from secflow.functions.versions import in_range, version_key
from secflow.operators import windows as W

ROW = "who string, outcome string, address string, code string, act string, tags array<string>, teams array<string>, verified boolean, encoded string"
MIRA = ("Mira", "Denied", "192.0.2.77", "502", "RotateSigningKey", ["gold", "edge"], None, False, base64.b64encode(b"a token b").decode())
#: field, values, modifiers, whether the row matches.
CASES = [
    ("who", ["mIrA"], (), True),
    ("who", ["mira"], ("cased",), False),
    ("who", ["Mira"], ("cased",), True),
    ("who", ["m*a"], (), True),
    ("who", ["m??a"], (), True),
    ("who", ["m?a"], (), False),
    ("who", ["m\\*a"], (), False),
    ("who", ["otto", "mira"], (), True),
    ("who", ["otto", None], (), False),
    ("who", ["act"], ("fieldref",), False),
    ("who", ["198.51.100.0/24"], ("cidr",), False),
    ("outcome", ["ENI"], ("contains",), True),
    ("outcome", ["den"], ("startswith",), True),
    ("outcome", ["nied"], ("endswith",), True),
    ("outcome", ["nied"], ("startswith",), False),
    ("outcome", ["D\\w+d$"], ("re",), True),
    ("outcome", ["d\\w+d$"], ("re",), False),
    ("outcome", ["d\\w+d$"], ("re", "i"), True),
    ("address", ["192.0.2.64/26"], ("cidr",), True),
    ("address", ["192.0.2.0/26"], ("cidr",), False),
    ("code", [502], (), True),
    ("code", [502], ("gte",), True),
    ("code", [502], ("gt",), False),
    ("code", [1000], ("lt",), True),
    ("tags", ["Gold"], (), True),
    ("tags", ["edge", "gold"], ("all",), True),
    ("tags", ["gold", "core"], ("all",), False),
    ("teams", [None], (), True),
    ("teams", [True], ("exists",), False),
    ("teams", [False], ("exists",), True),
    ("verified", [False], (), True),
    ("verified", [True], (), False),
    ("encoded", ["token"], ("base64offset", "contains"), True),
    ("act", ["rotatesigningkey"], (), True),
]


@pytest.mark.parametrize("field,values,mods,expected", CASES)
def test_modifiers(spark, field, values, mods, expected):
    df = spark.createDataFrame([MIRA], ROW)
    p = P.predicate(df.schema, field, values, mods)
    assert df.select(p, ~p).first() == (expected, not expected)


def test_condition_quantifiers(spark):
    df = spark.createDataFrame([(True, False, True)], "a boolean, b boolean, c boolean")
    searches = {"sel_a": F.col("a"), "sel_b": F.col("b"), "filter_c": F.col("c")}
    for text, want in (("1 of sel_*", True), ("all of sel_*", False), ("sel_a and not filter_c", False), (["sel_b", "sel_a"], True), ("all of them", False)):
        assert P.with_condition(df, searches, text).first().matched is want


@pytest.mark.parametrize("inclusive,sessions", [(False, 2), (True, 1)])
def test_gap_boundary(spark, inclusive, sessions):
    df = spark.createDataFrame([("k", 0, 1), ("k", 300 * W.SECOND, 2)], "key string, t long, id long")
    assert W.sessions(df, ["key"], 300, inclusive, ["id"]).select("session").distinct().count() == sessions


def test_suppression_fires_again_at_exactly_the_end(spark):
    df = spark.createDataFrame([("k", s * W.SECOND, i) for i, s in enumerate((0, 100, 310, 350, 610, 700))], "key string, t long, id long")
    assert sorted(r.t // W.SECOND for r in W.suppress(df, ["key"], 300, ["id"]).collect()) == [0, 310, 610]


def test_window_counts_both_ends_and_ties(spark):
    df = spark.createDataFrame([("k", 0, 1), ("k", 900 * W.SECOND, 2), ("k", 900 * W.SECOND, 3), ("k", 901 * W.SECOND, 4), (None, 5, 5)], "key string, t long, id long")
    got = {r.id: r.observed for r in W.observe(df, ["key"], 900, order=["id"]).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


@pytest.mark.parametrize("low,high", [("2.9.9", "2.10.0"), ("2.4.0-rc1", "2.4.0"), ("1.0-alpha", "1.0-beta"), ("1.0-beta.2", "1.0-beta.11"), ("1", "1.0.1")])
def test_version_order(spark, low, high):
    assert spark.range(1).select(version_key(F.lit(low)) < version_key(F.lit(high))).first()[0]


@pytest.mark.parametrize("a,b", [("v2.4.1", "2.4.1"), ("1.0", "1.0.0"), ("2.4.1+build9", "2.4.1")])
def test_version_equality(spark, a, b):
    assert spark.range(1).select(version_key(F.lit(a)) == version_key(F.lit(b))).first()[0]


@pytest.mark.parametrize("version,spec,inside", [("2.4.1", ">=2.4.0 <2.4.2", True), ("2.4.2", ">= 2.4.0, < 2.4.2", False), ("2.4.0-rc1", ">=2.4.0 <2.4.2", False), ("1.9.0", "^1.2.3", True), ("2.0.0", "^1.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~>1.2.3", False), ("9", "*", True), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", True), ("1.0.0", "^0.2.3", False)])
def test_ranges(spark, version, spec, inside):
    assert spark.range(1).select(in_range(F.lit(version), F.lit(spec))).first()[0] is inside


def test_times(spark):
    ref = F.lit("2026-01-01 12:00:00").cast("timestamp")
    at = lambda s: str(spark.range(1).select(parse_time(F.lit(s), ref)).first()[0])
    assert at("1700000000") == at("1700000000000") == "2023-11-14 22:13:20"
    assert at("Sep  9 13:42:10") == "2025-09-09 13:42:10" and at("Jan  1 01:00:00") == "2026-01-01 01:00:00"
    assert at("2025-01-02T03:04:05Z") == "2025-01-02 03:04:05" and at("junk") == "None"


def test_scores(spark):
    score = lambda s, c, a, f: spark.range(1).select(risk.alert_score(F.lit(s), F.lit(c), F.lit(a), F.lit(f))).first()[0]
    assert score(10, 10, 10, 1.0) == 100 and score(10, 10, 10, 1.6) == 100 and score(5, 5, 5, 0.4) == 20 and score(5, 5, 5, 1.6) == 75
