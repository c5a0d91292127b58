"""Streams group by buckets of keys: what a group costs isn't paid for each key, and keys that share a bucket don't mix."""

import numpy as np
import pandas as pd

from secflow.streaming import jobs
from secflow.streaming import processors as R

SECOND = 1_000_000


def test_keys_of_a_bucket_keep_apart(spark, tmp_path):
    """Three groups for 40 keys: null and numbers beyond a double's digits are keys of their own, idle ones leave, the others stay."""
    inbox, out, state = (f"file://{tmp_path}/{n}" for n in ("inbox", "out", "state"))
    keys = [None, 2**53, 2**53 + 1, *range(37)]
    busy = [None, 2**53 + 1, *range(0, 37, 2)]
    for run in ([(k, t) for k in keys for t in (50, 55)], [(k, 100) for k in busy]):
        spark.createDataFrame([(k, t * SECOND) for k, t in run], "key long, t long").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("key long, t long").parquet(inbox)
        told = R.windows(stream, ["key"], 10, buckets=3)
        found = jobs.collect_to(told, out, checkpoint=state)
    want = [(k, 55 * SECOND, 2, True) for k in keys] + [(k, 100 * SECOND, 1, True) for k in busy] + [(k, 55 * SECOND, 0, False) for k in keys if k not in busy]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert "[_bucket" in told._jdf.queryExecution().analyzed().toString()


def test_rows_of_a_bucket_are_dealt_by_key():
    a = pd.DataFrame({"k": ["x", None, "y"], "l": ["1", "1", "2"], "t": [3, 9, 5], "id": [7, 1, 2], "other": [0, 0, 0]})
    b = pd.DataFrame({"k": ["x", "x", None, "x"], "l": ["1", "2", "1", "1"], "t": [3, 1, 2, 1], "id": [4, 3, 5, 6], "other": [0, 0, 0, 0]})
    found = {key: [c.tolist() for c in columns] for key, columns in R.by_key(iter([a, b]), ["k", "l"], ("t", "id"))}
    assert found == {("x", "1"): [[1, 3, 3], [6, 4, 7]], (None, "1"): [[2, 9], [5, 1]], ("y", "2"): [[5], [2]], ("x", "2"): [[1], [3]]}


def test_pauses_and_thresholds_go_on_where_a_micro_batch_ended():
    pauses = R.Silence(["k"], 10)
    told, _, held = pauses.step([np.array([0, 5 * SECOND])], None, None)
    assert [c.tolist() for c in told] == [[], []] and held.tolist() == [5 * SECOND]
    told, _, held = pauses.step([np.array([16 * SECOND, 18 * SECOND])], None, held)
    assert [c.tolist() for c in told] == [[5 * SECOND], [15 * SECOND]] and held.tolist() == [18 * SECOND]
    three = R.Threshold(["k"], 10, 3, 20, "id")
    told, fired, held = three.step([np.array([0, 4]) * SECOND, np.array([1, 2])], None, None)
    assert fired is None and told[0].tolist() == []
    told, fired, held = three.step([np.array([8, 9, 29]) * SECOND, np.array([3, 4, 5])], fired, held)
    assert [c.tolist() for c in told] == [[3], [8 * SECOND], [3]] and fired == 8 * SECOND and held.tolist() == [29 * SECOND]
