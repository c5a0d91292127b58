"""The stored alert table: against plain Python over batches, replays, failures between and odd keys."""

import os

import pytest

from secflow.sources import sinks

KIND = "tenant string, rule_id string, principal string, t long, id long, occurrences long, risk_score long, level string"
KEYS = ["tenant", "rule_id", "principal"]


def batch_of(n):
    rows = [(f"t{i % 3}", f"r{i % 4}", None if i % 7 == 0 else f"p{i % 5}", 1000 * n + i, 100 * n + i, 1 + i % 3, (i * 37 + n * 11) % 50, f"l{(i + n) % 3}") for i in range(60)]
    return rows + ([(None, "r0", "p0", 5, 9000 + n, 1, n, "l0")] if n < 2 else [])


def plain(batches):
    held = {}
    for rows in batches:
        for tenant, rule, who, t, i, n, risk, level in rows:
            old = held.get((tenant, rule, who), (0, t, t, (-1, -1, -1), None))
            best = max((old[3], old[4]), ((risk, t, i), level))
            held[tenant, rule, who] = (old[0] + n, min(old[1], t), max(old[2], t), *best)
    return {k: (v[0], v[1], v[2], v[3][0], v[4]) for k, v in held.items()}


def stored(spark, path):
    return {(r.tenant, r.rule_id, r.principal): (r.occurrences, r.first_seen, r.last_seen, r.risk_score, r.level) for r in spark.read.parquet(path).collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_batches_and_replays(spark, tmp_path):
    path = f"{tmp_path}/alerts"
    for n in (0, 1, 1, 2, 2):
        sinks.upsert_alerts(spark.createDataFrame(batch_of(n), KIND), path, KEYS, n, buckets=4)
    assert stored(spark, path) == plain(map(batch_of, range(3)))
    sinks.upsert_alerts(spark.createDataFrame([], KIND), path, KEYS, 3, buckets=4)
    assert stored(spark, path) == plain(map(batch_of, range(3)))


def test_other_parts_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/alerts"
    sinks.upsert_alerts(spark.createDataFrame(batch_of(0), KIND), path, KEYS, 0, buckets=4)
    before = files(path)
    one = [("t1", "r1", "p1", 9_999_999, 9_999_999, 1, 0, "l0")]
    sinks.upsert_alerts(spark.createDataFrame(one, KIND), path, KEYS, 1, buckets=4)
    gone = before - files(path)
    assert gone and len({os.path.dirname(f) for f in gone}) == 1 and len(before & files(path)) == len(before) - len(gone)
    assert stored(spark, path) == plain([batch_of(0), one])


@pytest.mark.parametrize("placed", [False, True])
def test_failure_between_stage_and_table(spark, tmp_path, monkeypatch, placed):
    """The call fails when the stage is written (and, in the second case, the table too); the repeated batch counts once."""
    path = f"{tmp_path}/alerts"
    sinks.upsert_alerts(spark.createDataFrame(batch_of(0), KIND), path, KEYS, 0, buckets=4)
    with monkeypatch.context() as m:
        m.setattr(sinks, "delete", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.upsert_alerts(spark.createDataFrame(batch_of(1), KIND), path, KEYS, 1, buckets=4)
    if not placed:
        # The table as it was before, the stage beside it.
        import shutil

        shutil.rmtree(path)
        sinks.upsert_alerts(spark.createDataFrame(batch_of(0), KIND), path, KEYS, 0, buckets=4)
    sinks.upsert_alerts(spark.createDataFrame(batch_of(1), KIND), path, KEYS, 1, buckets=4)
    assert stored(spark, path) == plain([batch_of(0), batch_of(1)])
    assert not os.path.exists(f"{path}-staged/batch=1")
