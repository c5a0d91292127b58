"""Stateful stream processors: windows, stages, silence, lateness and idle keys, each with its own typed state and timers.

A processor sees the rows of a bucket of keys of one micro-batch as arrays, key by key, merges
them with the times that it holds and finds counts by binary search, so no window is rebuilt per
event. The state lies in the state store (RocksDB); an event-time timer clears a key once the
watermark has passed all that it could still matter for.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
#: Buckets of keys; a task holds the keys and the micro-batch's rows of one bucket at a time.
BUCKETS = 1024
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; a stream takes its settings when it starts."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def by_key(batches: Iterator[pd.DataFrame], names: list[str], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Each key of a bucket's rows with its rows of ``columns``, sorted by the first, then the second. Other columns are let go batch by batch."""
    parts = [[b[c].to_numpy() for c in (*names, *columns)] for b in batches]
    arrays = [np.concatenate([p[i] for p in parts]) for i in range(len(names) + len(columns))]
    codes = np.zeros(len(arrays[0]), np.int64)
    for values in arrays[: len(names)]:
        code, distinct = pd.factorize(values, use_na_sentinel=False)
        codes = pd.factorize(codes * len(distinct) + code)[0]
    # By the key first, then the first column; lexsort takes its last array first.
    order = np.lexsort((*reversed(arrays[len(names) :][:2]), codes))
    arrays = [a[order] for a in arrays]
    cuts = [0, *(np.flatnonzero(np.diff(codes[order])) + 1).tolist(), len(order)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        yield tuple(a[start] if isinstance(a[start], str) else None for a in arrays[: len(names)]), [a[start:end] for a in arrays[len(names) :]]


def fires(times: np.ndarray, fired: int | None, ttl: int) -> tuple[list[int], int | None]:
    """Positions of sorted times that fire when each silences the next ``ttl`` microseconds, and the last time fired. Each step jumps over a silence."""
    found, at = [], 0
    while True:
        if fired is not None:
            at = max(at, int(np.searchsorted(times, fired + ttl, "left")))
        if at >= len(times):
            return found, fired
        found.append(at)
        fired, at = int(times[at]), at + 1


class Keyed(StatefulProcessor):
    """A processor whose keys are cleared ``keep`` microseconds of event time after their newest row.

    Keys are dealt over buckets, and a bucket is what Spark groups by: its calls to the state
    store and its frame of results are paid once a bucket and micro-batch, not once a key. A
    bucket holds one row per key: the key, its newest time, when it last fired, and its times.
    One timer per bucket wakes when its first key is done. A timer that wakes before that is
    set again, so rows don't move timers but for a key that is done before all others.
    """

    names: list[str]
    keep: int
    #: Columns read of the rows, the time first, and columns told beside the key.
    reads: tuple[str, ...] = ("t",)
    tells: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "key array<string>, t long, fired long, times array<long>")
        self.wakes = handle.getValueState("wakes", "at long")

    def step(self, rows: list[np.ndarray], fired: int | None, times: np.ndarray | None) -> tuple[tuple, int | None, np.ndarray]:
        """What is told of a key's new rows, column by column, when it last fired, and the times to hold; ``times`` is null for a new key."""
        raise NotImplementedError

    def done(self, newest: int) -> tuple | None:
        """What is told of a key that is cleared, if anything."""
        return None

    def due(self, t: int) -> int:
        """The first millisecond at which a key last seen at ``t`` is done."""
        return -((-t - self.keep) // 1000)

    def told(self, keys: list[tuple], columns: list[tuple]) -> Iterator[pd.DataFrame]:
        """One frame of what is told of several keys. Keys are plain objects: newer string types come in chunks, which the worker doesn't take."""
        sizes = [len(c[0]) for c in columns]
        if sum(sizes):
            of = np.repeat(np.arange(len(keys)), sizes)
            named = {name: pd.Series([keys[i][n] for i in of], dtype=object) for n, name in enumerate(self.names)}
            yield pd.DataFrame({**named, **{name: np.concatenate([c[n] for c in columns]) for n, name in enumerate(self.tells)}})

    def wake(self, held: list[tuple], watermark: int) -> None:
        """Sees to it that the bucket's timer wakes when its first key is done, or before."""
        first = max(min(self.due(h[1]) for h in held), watermark)
        if self.wakes.exists():
            at = self.wakes.get()[0]
            if at <= first:
                return
            self.handle.deleteTimer(at)
        self.handle.registerTimer(first)
        self.wakes.update((first,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {tuple(k): (t, fired, times) for k, t, fired, times in self.held.get()}
        keys, columns = [], []
        for own, arrays in by_key(rows, self.names, self.reads):
            newest, fired, times = held.get(own, (None, None, None))
            told, fired, times = self.step(arrays, fired, None if times is None else np.array(times, np.int64))
            last = int(arrays[0][-1])
            held[own] = (last if newest is None else max(newest, last), fired, times.tolist())
            keys.append(own)
            columns.append(told)
        state = [(list(k), *h) for k, h in held.items()]
        self.held.put(state)
        self.wake(state, timerValues.getCurrentWatermarkInMs() + 1)
        yield from self.told(keys, columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        kept, gone = [], []
        for h in self.held.get():
            (gone if self.due(h[1]) < watermark else kept).append(h)
        self.wakes.clear()
        if kept:
            if gone:
                self.held.put(kept)
            self.wake(kept, watermark)
        else:
            self.held.clear()
        last = [(tuple(h[0]), row) for h in gone if (row := self.done(h[1])) is not None]
        yield from self.told([k for k, _ in last], [tuple([x] for x in row) for _, row in last])

    def close(self) -> None:
        pass


class Threshold(Keyed):
    """Fires when at least so many rows lie in the last ``span`` seconds, then is silent for ``ttl`` seconds."""

    def __init__(self, names: list[str], span: int, at_least: int, ttl: int, id_column: str):
        self.names, self.span, self.at_least, self.ttl = names, span * SECOND, at_least, ttl * SECOND
        self.keep = max(self.span, self.ttl)
        self.reads, self.tells = ("t", id_column), (id_column, "t", "observed")

    def step(self, rows, fired, times):
        t, ids = rows
        held = np.empty(0, np.int64) if times is None else times
        merged = np.concatenate([held, t])
        order = np.argsort(merged, kind="stable")
        merged = merged[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        observed = place[len(held) :] - np.searchsorted(merged, t - self.span, "left") + 1
        hot = observed >= self.at_least
        found, fired = fires(t[hot], fired, self.ttl)
        return (ids[hot][found], t[hot][found], observed[hot][found]), fired, merged[np.searchsorted(merged, merged[-1] - self.span, "left") :]


class Stages(Keyed):
    """Fires when the rules were seen in order within ``span`` seconds, then is silent for as long.

    Held per key: for each stage the latest start of a chain of rules up to it. A chain is
    complete at a row if the last stage's start lies in the row's window.
    """

    NEVER = -(1 << 62)

    def __init__(self, names: list[str], rules: list[str], span: int, id_column: str):
        self.names, self.rules, self.span = names, rules, span * SECOND
        self.keep = self.span
        self.reads, self.tells = ("t", id_column, "rule_id"), ("t",)
        self.stage_of: dict[str, list[int]] = {}
        for s in reversed(range(len(rules))):  # the later stage of a repeated rule first
            self.stage_of.setdefault(rules[s], []).append(s)

    def step(self, rows, fired, times):
        t, _, rule = rows
        starts = [self.NEVER] * len(self.rules) if times is None else times.tolist()
        complete = np.zeros(len(t), bool)
        for i, (at, r) in enumerate(zip(t.tolist(), rule, strict=True)):
            for s in self.stage_of.get(r, ()):
                starts[s] = at if s == 0 else max(starts[s], starts[s - 1])
            complete[i] = starts[-1] >= at - self.span
        found, fired = fires(t[complete], fired, self.span)
        return (t[complete][found],), fired, np.array(starts, np.int64)


class Accepted(Keyed):
    """Passes a key's row unless one was passed less than ``ttl`` seconds before; rows not passed extend nothing."""

    def __init__(self, names: list[str], ttl: int, id_column: str):
        self.names, self.ttl = names, ttl * SECOND
        self.keep = self.ttl
        self.reads, self.tells = ("t", id_column), (id_column, "t")

    def step(self, rows, fired, times):
        t, ids = rows
        found, fired = fires(t, fired, self.ttl)
        return (ids[found], t[found]), fired, np.empty(0, np.int64)


class Silence(Keyed):
    """Tells of every pause of ``span`` seconds or more of a key: since when, and when it was due.

    A pause between two rows is told when the second arrives, one that lasts by the timer,
    without any row of the key; the key is then forgotten.
    """

    tells = ("since", "due")

    def __init__(self, names: list[str], span: int):
        self.names, self.keep = names, span * SECOND

    def step(self, rows, fired, times):
        (t,) = rows
        times = t if times is None else np.sort(np.concatenate([times, t]))
        since = times[:-1][np.diff(times) >= self.keep]
        return (since, since + self.keep), None, times[-1:]

    def done(self, newest):
        return newest, newest + self.keep


class Windows(Keyed):
    """Tells after each micro-batch what a key's window of ``span`` seconds holds, and when a timer lets an idle key go."""

    tells = ("last", "held", "alive")

    def __init__(self, names: list[str], span: int):
        self.names, self.keep = names, span * SECOND

    def step(self, rows, fired, times):
        (t,) = rows
        if times is not None:
            t = np.sort(np.concatenate([times, t]))
        t = t[np.searchsorted(t, t[-1] - self.keep, "left") :]
        return ([int(t[-1])], [len(t)], [True]), None, t

    def done(self, newest):
        return newest, 0, False


class Lateness(StatefulProcessor):
    """Marks a key's rows as late if they are older than its newest row of earlier micro-batches, less ``delay`` seconds."""

    def __init__(self, delay: int, id_column: str):
        self.delay, self.id_column = delay * SECOND, id_column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.newest.get()[0] if self.newest.exists() else None
        newest = before
        for batch in rows:
            t = batch["t"].to_numpy()
            late = np.zeros(len(t), bool) if before is None else t < before - self.delay
            newest = int(t.max()) if newest is None else max(newest, int(t.max()))
            yield pd.DataFrame({self.id_column: batch[self.id_column].to_numpy(), "t": t, "late": late})
        self.newest.update((newest,))

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, delay: int) -> DataFrame:
    return rows.withColumn("_time", F.timestamp_micros("t")).withWatermark("_time", f"{delay} seconds")


def _run(rows: DataFrame, made: Keyed, delay: int, told: str, buckets: int) -> DataFrame:
    """The processor's results, keys first. Keys travel as text, which has a null of its own where numbers don't, and are cast back."""
    kinds = dict(rows.dtypes)
    own = [F.col(k).cast("string").alias(k) for k in made.names]
    read = rows.select(F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int").alias("_bucket"), *own, *dict.fromkeys(("t", *made.reads)))
    schema = ", ".join([*(f"{k} string" for k in made.names), told])
    found = _timed(read, delay).groupBy("_bucket").transformWithStateInPandas(made, schema, "append", "EventTime")
    return found.select(*(F.col(k).cast(kinds[k]).alias(k) for k in made.names), *made.tells)


def threshold_alerts(events: DataFrame, keys: list[str], span: int, at_least: int, ttl: int, id_column: str = "event_id", buckets: int = BUCKETS) -> DataFrame:
    """Rows at which a key's window holds at least so many, each followed by a silence: keys, id, t, observed."""
    return _run(events, Threshold(keys, span, at_least, ttl, id_column), max(span, ttl), f"{id_column} long, t long, observed long", buckets)


def ordered_hits(alerts: DataFrame, keys: list[str], rules: list[str], span: int, id_column: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """Times at which a key's alerts complete the rules in order: keys, t."""
    return _run(alerts, Stages(keys, rules, span, id_column), span, "t long", buckets)


def accepted(events: DataFrame, keys: list[str], ttl: int, id_column: str = "event_id", buckets: int = BUCKETS) -> DataFrame:
    """Rows that no row accepted before silences: id, t."""
    return _run(events, Accepted(keys, ttl, id_column), ttl, f"{id_column} long, t long", buckets).select(id_column, "t")


def silent(events: DataFrame, keys: list[str], span: int, delay: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Pauses of keys: keys, since, due."""
    return _run(events, Silence(keys, span), delay, "since long, due long", buckets)


def windows(events: DataFrame, keys: list[str], span: int, delay: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """What each key's window holds after a micro-batch that touched it, and keys let go: keys, last, held, alive."""
    return _run(events, Windows(keys, span), delay, "last long, held long, alive boolean", buckets)


def lateness(events: DataFrame, keys: list[str], delay: int, id_column: str = "event_id") -> DataFrame:
    """All rows with ``late``; nothing is dropped, so late rows can go to a table of their own."""
    return events.groupBy(*keys).transformWithStateInPandas(Lateness(delay, id_column), f"{id_column} long, t long, late boolean", "append", "None")
