"""Histograms, health of a pipeline, evidence of matches: against plain Python, on odd rows."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from secflow.functions import histograms
from secflow.operators import detect
from secflow.streaming import health
from secflow.streaming import processors as R
from secflow.streaming.health import HOUR


def test_cells_are_close_and_whole_below_the_limit(spark):
    values = [0, 1, 127, 128, 129, 255, 256, 1000, 123_456_789, (1 << 62) + 12_345, (1 << 63) - 1, -5, None]
    got = dict(map(tuple, spark.createDataFrame([(v,) for v in values], "v long").select("v", histograms.cell(F.col("v"))).collect()))
    assert got[-5] == 0 and got[None] is None
    for v in values[:-2]:
        assert got[v] == v if v < 128 else 0 <= v - got[v] < v / 64, v


@pytest.mark.parametrize("n", [1, 2, 999])
def test_quantiles_of_merged_parts(spark, n):
    rnd = random.Random(n)
    values = [int(10 ** rnd.uniform(0, 9)) for _ in range(n)]
    rows = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)] + [(0, None)], "g int, v long").withColumn("one", F.lit(1))
    parts = [histograms.histogram(rows.where(f"g = {g}"), ["one"], F.col("v")) for g in (0, 1)]
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    (got,) = histograms.quantiles(parts[0].unionByName(parts[1]), ["one"], shares).collect()
    for name, share in shares.items():
        exact = sorted(values)[math.ceil(share * n) - 1]
        assert 0 <= exact - got[name] <= exact / 64
    assert histograms.quantiles(parts[0].limit(0), ["one"], shares).count() == 0


def test_health_of_hours(spark):
    row = lambda hour, taken=None, failed=False, code=200: (hour * HOUR + 5, None if taken is None else taken * HOUR + 9, failed, code)
    rows = [row(0, 0) for _ in range(20)] + [row(0, 3, code=503)] + [row(1, 1, True), row(1, 1)] + [row(4, None, None, None)] * 3
    kind = "t long, taken long, failed boolean, code int"
    parts = [health.counted(spark.createDataFrame(part, kind)) for part in (rows[:7], rows[7:])]
    whole = parts[0].unionByName(parts[1])
    got = {}
    for r in health.problems(whole, failures=40, server=4, least=2, backlog=2).collect():
        got.setdefault(r.start // HOUR, set()).add(r.problem)
    assert got == {0: {"server errors"}, 1: {"failure rate"}, 2: {"stalled", "little traffic"}, 3: {"stalled", "little traffic"}, 4: {"backlog"}}
    assert health.problems(whole.limit(0)).count() == 0


def test_lag_of_a_progress_report():
    report = {"sources": [{"metrics": {"maxOffsetsBehindLatest": "7"}}, {"metrics": {"maxOffsetsBehindLatest": "5"}}, {"description": "files"}]}
    assert health.lag(report) == health.lag(json.dumps(report)) == 12
    assert health.lag({"sources": [{"metrics": {}}]}) is None and health.lag({}) is None


def test_evidence_is_of_the_first_group_that_holds(spark):
    rule = detect.Rule("r", "R", "low", {"one": [{"a|startswith": "x", "b": 1}, {"tags": "t"}], "other": [{"a": "xyz"}]}, "1 of them", fields=("c", "a", "missing"))
    rows = [(3002, "xyz", 1, ["t"], None), (3002, "q", 1, ["t", "u"], "shown"), (3002, "xyz", 2, None, "shown"), (3002, None, None, None, "x")]
    df = spark.createDataFrame(rows, "class_uid int, a string, b int, tags array<string>, c string")
    got = [(r.searches, r.evidence) for r in detect.with_evidence(detect.match_rules(df, [rule]), [rule]).collect()]
    assert got == [(["one", "other"], {"a": "xyz", "b": "1"}), (["one"], {"tags": '["t","u"]', "c": "shown", "a": "q"}), (["other"], {"a": "xyz", "c": "shown"})]


def test_idle_keys_leave_the_state(spark, tmp_path):
    """One key goes on, one stops: its timer lets it go; one comes back and starts anew."""
    from secflow.streaming import jobs

    inbox, out, state = (f"file://{tmp_path}/{n}" for n in ("inbox", "out", "state"))
    second = 1_000_000
    for run in ([("a", 0), ("b", 0), ("b", 5), ("c", 1)], [("a", 30)], [("a", 60), ("c", 61), ("c", 62)], [("a", 65)]):
        spark.createDataFrame([(k, t * second) for k, t in run], "key string, t long").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("key string, t long").parquet(inbox)
        found = jobs.collect_to(R.windows(stream, ["key"], 10), out, checkpoint=state)
    rows = [tuple(r) for r in found.collect()]
    assert ("b", 5 * second, 0, False) in rows and ("c", second, 0, False) in rows
    assert sorted(r for r in rows if r[0] == "c" and r[3]) == [("c", second, 1, True), ("c", 62 * second, 2, True)]
    assert ("a", 65 * second, 2, True) in rows and ("a", 65 * second, 0, False) not in rows
