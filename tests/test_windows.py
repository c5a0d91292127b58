"""Sliding windows, numbering and percentiles against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from secflow.operators import incidents, metrics, windows
from secflow.operators.windows import SECOND


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    return [(i, rnd.choice(["a", "b", None]), rnd.randrange(60) * SECOND, rnd.choice(["x", "y", "z", None])) for i in range(300)]


def inside(rows, r, span, same_key=True):
    return [o for o in rows if (o[1] == r[1] or not same_key) and r[2] - span * SECOND <= o[2] <= r[2]]


@pytest.mark.parametrize("span", [0, 1, 7, 100])
def test_distinct_values(spark, rows, span):
    df = spark.createDataFrame(rows, "event_id long, k string, t long, v string")
    got = {r.event_id: r.observed for r in windows.observe(df, ["k"], span, "distinct", "v").collect()}
    assert got == {r[0]: len({o[3] for o in inside(rows, r, span)} - {None}) for r in rows if r[1] is not None}


@pytest.mark.parametrize("span", [0, 5, 1000])
def test_count_of_all(spark, rows, span):
    df = spark.createDataFrame(rows, "event_id long, k string, t long, v string")
    got = {r.event_id: r.observed for r in windows.count_all(df, span, "event_id").collect()}
    assert got == {r[0]: len(inside(rows, r, span, False)) for r in rows}


def test_evidence_of_what_fired(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, k string, t long, v string").where("k IS NOT NULL")
    fired = windows.threshold(windows.observe(df, ["k"], 9), ">=", 12)
    got = {r.event_id: (r.event_ids, r.first_seen) for r in windows.evidence(fired.select("k", "event_id", "t"), df, ["k"], 9, "event_id").collect()}
    want = {r[0]: (sorted(o[0] for o in inside(rows, r, 9)), min(o[2] for o in inside(rows, r, 9))) for r in rows if r[1] is not None}
    assert got == {i: w for i, w in want.items() if len(w[0]) >= 12} and got


def test_numbers_of_incidents(spark, rows):
    df = spark.createDataFrame(rows, "id long, tenant string, t long, v string")
    got = {r.id: r.key for r in incidents.numbered(df, "tenant", ["t", "id"]).collect()}
    for tenant in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == tenant), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in own] == [f"INC-{2001 + i}" for i in range(len(own))]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_percentiles(spark, rows, keys):
    df = spark.createDataFrame([(r[1], r[2] // SECOND - 5) for r in rows], "k string, s long")
    got = {r[0] if keys else "all": r for r in metrics.summarise(df, keys, "s").collect()}
    for k in {r[1] for r in rows} if keys else {"all"}:
        own = sorted(r[2] // SECOND - 5 for r in rows if (not keys or r[1] == k) and r[2] // SECOND >= 5)
        r = got[k]
        assert (r.n, r.mean, r.median, r.p90) == (len(own), round(statistics.mean(own), 6), statistics.median(own), own[min(int(len(own) * 0.9), len(own) - 1)])


def test_nothing(spark):
    df = spark.createDataFrame([], "event_id long, k string, t long, v string")
    assert windows.observe(df, ["k"], 5, "distinct", "v").count() == windows.count_all(df, 5, "event_id").count() == 0
    assert metrics.summarise(df.select("k", F.col("t").alias("s")), ["k"], "s").count() == 0
