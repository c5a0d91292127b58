"""Line deduplication with levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of (128-bit line hash, documents that hold the line), bucketed by the hash
and sorted within each bucket, so that runs meet bucket by bucket, without a shuffle.
``LineRuns.add`` takes a batch's line counts, drops the lines that some run already knows as
frequent by a merge anti-join with every run (their count can no longer matter), and adds
the rest as a new run on level 0. Once a level has two runs they are merged into one run of
the next level, by a merge join. ``frequent`` merges what is left. So each batch costs its
own size plus an amortised share of the merges, and no count is kept in memory or on the
driver.

A line's key is the line with white space [\\x20\\x09-\\x0D] stripped at both ends and A-Z
lower-cased. Keys of at least ``min_chars`` code points found in at least ``min_docs``
documents lose all their lines in every document.

Rows: a null or empty text is one empty line and stays as it is (kept text ''). Rows that
share an id are one document when lines are counted, rows without an id too; each keeps a
row of its own. Other columns pass through, same-named ones are replaced; an empty table
gives an empty table. Texts are read whole, once; from then on lines are hashes and
positions. One line in a third of all documents is counted with map-side combining, and the
join back to documents is one that Spark can split. A document's lines are dropped by
slices between their positions, in time proportional to its lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.llm.common import LOWER, SPACES, UPPER, discard, materialise, new_table, read


def line_key(line: Column) -> Column:
    """The line stripped at both ends, with A-Z lower-cased."""
    cut = F.btrim(line, F.lit(SPACES))
    # For ASCII, lower() changes just A-Z and is much faster than translate().
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(doc_id, row, i, h1, h2) of every line with a key; ``row`` is the hash of the text, ``i`` the line's position."""
    keys = F.transform(lines_of(F.col(text)), line_key)
    hashed = F.transform(keys, lambda k, i: F.struct(i.alias("i"), F.char_length(k).alias("n"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2")))
    found = docs.select("doc_id", F.xxhash64(text).alias("row"), F.explode(F.filter(hashed, lambda x: x["n"] >= min_chars)).alias("x"))
    return found.select("doc_id", "row", "x.i", "x.h1", "x.h2")


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs), as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def table(self, rows: DataFrame, *partitions: str) -> str:
        """Writes rows as a table of sorted buckets. Each bucket lies in one task already or is brought there."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.partitionBy(*partitions).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", new_table(self.spark, name)).saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            files = self.spark.table(name)
            discard(self.spark, files)
            self.spark.sql(f"DROP TABLE {name}")

    def merged(self, one: str, two: str) -> DataFrame:
        """Two runs as one: a merge join of sorted buckets."""
        a, b = self.spark.table(one), self.spark.table(two).withColumnRenamed("n_docs", "more")
        both = a.hint("merge").join(b, ["h1", "h2"], "full")
        return both.select("h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))

    def add(self, counts: DataFrame) -> None:
        """Adds a batch's (h1, h2, n_docs)."""
        for run in [run for level in self.levels for run in level]:
            known = self.spark.table(run).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            counts = counts.join(known.hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self.table(counts))
        at = 0
        while len(self.levels[at]) == 2:
            old = self.levels[at]
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self.table(self.merged(*old)))
            self.levels[at] = []
            self.drop(*old)
            at += 1

    def frequent(self) -> DataFrame:
        """Hashes of the lines found in at least ``min_docs`` documents so far."""
        runs = [run for level in self.levels for run in level]
        while len(runs) > 1:
            one, two, *rest = runs
            runs = [self.table(self.merged(one, two)), *rest]
            self.drop(one, two)
        self.levels = [runs]
        return self.spark.table(runs[0]).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")

    def close(self) -> None:
        """Drops all runs."""
        self.drop(*(run for level in self.levels for run in level))
        self.levels = [[]]


def batch_counts(lines: DataFrame, runs: LineRuns, batches: int) -> str:
    """A table of sorted buckets, one partition a batch: the number of documents of every line. An id is in one batch only."""
    held = lines.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "h1", "h2", "doc_id").distinct()
    counts = held.groupBy("h1", "h2", "batch").agg(F.count(F.lit(1)).alias("n_docs"))
    return runs.table(counts.repartition(runs.buckets, "h1", "h2"), "batch")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, text: str = "text") -> DataFrame:
    """``docs`` with text replaced by its kept lines, plus ``n_lines`` and ``n_dropped``.

    ``batches``: the table is added to the runs in so many batches, as a growing corpus would be.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs)
    lines = materialise(line_hashes(docs, text, min_chars), "lines")
    counts = batch_counts(lines, runs, batches)
    for b in range(batches):
        runs.add(spark.table(counts).where(F.col("batch") == b).select("h1", "h2", "n_docs"))
    # A table of its own, so that Spark can split the join where one line is everywhere.
    frequent = materialise(runs.frequent(), "frequent-lines")
    runs.drop(counts)
    runs.close()
    # Only the positions of the lines to drop travel to their documents.
    hits = lines.join(frequent, ["h1", "h2"])
    drops = materialise(hits.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.sort_array(F.collect_set("i")).alias("_drop")), "dropped-lines")
    discard(spark, lines, frequent)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "_id", "_row", "_drop", "_lines")]
    joined = docs.select(*rest).join(drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_row")), "left").withColumn("_lines", lines_of(F.col(text)))
    # What stays lies between the positions: before the first, between two, after the last.
    before = F.concat(F.array(F.lit(0)), F.transform("_drop", lambda i: i + 1))
    until = F.concat("_drop", F.array(F.size("_lines")))
    kept = F.flatten(F.transform(F.arrays_zip(before.alias("a"), until.alias("b")), lambda x: F.slice("_lines", x["a"] + 1, x["b"] - x["a"])))
    stays = F.when(F.col("_drop").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *(stays.alias(c) if c == text else F.col(c) for c in rest),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": ORACLE}
