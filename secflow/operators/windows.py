"""Sliding windows, suppression and sessions over event time in microseconds.

All are window functions or folds keyed by a group; a hot group is one sorted partition
that Spark can spill, except for the folds, which see only threshold-crossing rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.operators import ranges

SECOND = 1_000_000
COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def frame(keys: list[str], span: int, time: str = "t"):
    """Events of the last ``span`` seconds, both ends included."""
    return Window.partitionBy(*keys).orderBy(time).rangeBetween(-span * SECOND, 0)


def exact_count(keys: list[str], span: int, order: list[str], time: str = "t") -> Column:
    """Events of the last ``span`` seconds seen so far, when equal times arrive in ``order``."""
    so_far = F.row_number().over(Window.partitionBy(*keys).orderBy(time, *order))
    before = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, -span * SECOND - 1))
    return so_far - before


def distinct_so_far(df: DataFrame, keys: list[str], span: int, field: str, time: str = "t") -> DataFrame:
    """Adds ``observed``: the distinct values in the window that ends at each row, equal times included.

    A row's value is new to the windows that end from its own time (or, if the value came
    before, from when that earlier row has left) until the row itself leaves. So each row adds
    one at the start of that stretch and takes one away behind it, and a running sum over the
    key's times is the count: no window's values are ever gathered.
    """
    before = F.lag(time).over(Window.partitionBy(*keys, field).orderBy(time))
    start = F.greatest(F.col(time), F.coalesce(F.col("_before") + span * SECOND + 1, F.col(time)))
    end = F.col(time) + span * SECOND
    step = lambda at, delta: F.struct(at.alias("at"), F.lit(delta).alias("delta"))
    told = F.when(F.col(field).isNotNull() & (start <= end), F.array(step(start, 1), step(end + 1, -1))).otherwise(F.array().cast("array<struct<at:bigint,delta:int>>"))
    steps = df.withColumn("_before", before).withColumn("_x", F.explode(F.concat(F.array(step(F.col(time), 0)), told)))
    running = F.sum("_x.delta").over(Window.partitionBy(*keys).orderBy("_x.at").rangeBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("observed", running).where("_x.delta = 0").drop("_before", "_x")


def count_all(df: DataFrame, span: int, id_column: str, time: str = "t") -> DataFrame:
    """(id, observed): events of all groups together in the last ``span`` seconds, equal times included; counted over ranges of time, not in one task."""
    mark = lambda at, side, n, sign: F.struct(at.alias("at"), F.lit(side).alias("side"), F.lit(n).alias("n"), F.lit(sign).alias("sign"))
    marks = df.select(id_column, F.explode(F.array(mark(F.col(time), 0, 1, 0), mark(F.col(time), 1, 0, 1), mark(F.col(time) - span * SECOND, -1, 0, -1))).alias("x")).select(id_column, "x.*")
    summed = ranges.running(marks, [], ["at", "side"], upto=F.col("n"))
    return summed.groupBy(id_column).agg(F.sum(F.col("upto") * F.col("sign")).alias("observed"))


def observe(df: DataFrame, keys: list[str], span: int, what: str = "count", field: str | None = None, time: str = "t", order: list[str] | None = None) -> DataFrame:
    """Adds ``observed``: the aggregate of the window that ends at each row. Rows without a group value make no statement."""
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    if what == "distinct":
        return distinct_so_far(present, keys, span, field, time)
    w = frame(keys, span, time)
    found = {"count": lambda: exact_count(keys, span, order, time) if order else F.count(F.lit(1)).over(w), "min": lambda: F.min(field).over(w), "max": lambda: F.max(field).over(w), "sum": lambda: F.sum(field).over(w), "avg": lambda: F.avg(field).over(w)}
    return present.withColumn("observed", found[what]())


def threshold(df: DataFrame, op: str, value: float) -> DataFrame:
    """Rows whose ``observed`` value meets the threshold."""
    return df.where(COMPARE[op](F.col("observed"), value))


def evidence(fired: DataFrame, events: DataFrame, keys: list[str], span: int, id_column: str, time: str = "t") -> DataFrame:
    """``fired`` rows with the ids in the window that ends at each, sorted, and the time of the first.

    Only windows of rows that fired are gathered: they meet the key's events by slices of one
    window's length, of which a window touches two.
    """
    slice_of = lambda at: F.floor(at / (span * SECOND))
    asked = fired.withColumn("_slice", F.explode(F.array(slice_of(F.col(time)) - 1, slice_of(F.col(time)))))
    held = events.select(*keys, slice_of(F.col(time)).alias("_slice"), F.col(time).alias("_at"), F.col(id_column).alias("_id"))
    met = asked.join(held, [*keys, "_slice"]).where(F.col("_at").between(F.col(time) - span * SECOND, F.col(time)))
    return met.groupBy(*fired.columns).agg(F.array_sort(F.collect_list("_id")).alias("event_ids"), F.min("_at").alias("first_seen"))


def suppress(df: DataFrame, keys: list[str], ttl: int, columns: list[str], time: str = "t") -> DataFrame:
    """Per key: the first row fires, then none until ``ttl`` seconds after the last that fired; a row at exactly the end fires.

    A fold over a run of the key's rows in time order; suppressed rows don't extend the
    silence. A pause of ``ttl`` seconds ends a run: the row after it fires whatever came
    before, so each run is folded by itself. Of rows with equal times only the first can fire.
    """
    order = Window.partitionBy(*keys).orderBy(time, *columns)
    same = F.coalesce(F.lag(time).over(order) == F.col(time), F.lit(False))
    firsts = df.withColumn("_same", same).where("NOT _same" if ttl > 0 else "true").drop("_same")
    df, keys = sessions(firsts, keys, ttl, False, columns, time).withColumnRenamed("session", "_run"), [*keys, "_run"]
    row = F.struct(F.col(time).alias("_t"), *columns)
    rows = F.sort_array(F.collect_list(row))
    empty = F.expr("filter(array(NULL), x -> x IS NOT NULL)")
    grouped = df.groupBy(*keys).agg(rows.alias("_rows"))
    kind = grouped.schema["_rows"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("bigint").alias("last"), empty.cast(kind).alias("fired"))

    def step(state: Column, x: Column) -> Column:
        fires = state["last"].isNull() | (x["_t"] - state["last"] >= ttl * SECOND)
        return F.struct(F.when(fires, x["_t"]).otherwise(state["last"]).alias("last"), F.when(fires, F.concat(state["fired"], F.array(x))).otherwise(state["fired"]).alias("fired"))

    fired = grouped.select(*keys, F.explode(F.aggregate("_rows", start, step, lambda s: s["fired"])).alias("_x"))
    return fired.select(*keys[:-1], F.col("_x._t").alias(time), *(F.col("_x")[c].alias(c) for c in columns if c != time))


def sessions(df: DataFrame, keys: list[str], gap: int, inclusive: bool, order: list[str], time: str = "t") -> DataFrame:
    """Adds ``session``: a number that grows where the pause since the key's last row is too long.

    ``inclusive``: a pause of exactly ``gap`` seconds still belongs to the session.
    """
    w = Window.partitionBy(*keys).orderBy(time, *order)
    pause = F.col(time) - F.lag(time).over(w)
    starts = (pause > gap * SECOND) if inclusive else (pause >= gap * SECOND)
    return df.withColumn("_new", F.coalesce(starts.cast("int"), F.lit(0))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
