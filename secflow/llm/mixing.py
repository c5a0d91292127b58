"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in the source's shuffled order (by the MD5 of its
id). A source is read again from its start when it ends, twice at most. A copy's virtual
finish time is the source's words up to and including it divided by the source's target.
All copies, range-sorted by finish time, form the mixed order, truncated where the total
budget ends; the copy on the border is taken in part. ``mix_documents`` returns the
documents in that order, partition after partition.

The cumulative sums are distributed: words are summed by (source, hash range) first, so
one window never holds more than one hash range of one source; the global order uses
ranges of the finish time in the same way. There are about as many ranges as a range has
documents (the square root of all), so neither the windows nor the sums that meet in one
task grow with the corpus itself.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share ``share``
times all words; a target stops at ``repeats`` times its source's words, and the excess
goes to the others by weight.

Rows: a null text has size 0 and takes nothing; a null source is a source of its own; a
null doc_id hashes as an empty id. Repeated rows are documents of their own, and ties in
the order (same hash and id) fall to the smaller text size, then to the text's hash, so
reruns agree. Columns pass through, whatever their names; an empty table gives an empty
table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secflow.llm.common import discard, materialise, read

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of runs of anything but white space [\\x20\\x09-\\x0D]; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _keys() -> list[Column]:
    return [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")]


KEYS = ["no_source", "source_key"]


def source_targets(sums: DataFrame, share: float, repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: its words, weight and target. ``sums``: one row per source."""
    everything = Window.partitionBy()
    order = Window.orderBy(*KEYS)
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")), "weight", *KEYS)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = sums.withColumn("weight", weight.cast("long"))
    # Sources full at their cap come first in the order of cap / weight; the first source
    # whose share of what is left stays under its cap fixes the level for all after it.
    left_words = F.sum("source_size").over(everything) * share - F.coalesce(F.sum(repeats * F.col("source_size")).over(before), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("level", left_words / left_weight)
    t = t.withColumn("fits", F.col("level") * F.col("weight") <= repeats * F.col("source_size"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("weight"), *KEYS, F.col("level").alias("level")))).over(everything)["level"]
    cap = (repeats * F.col("source_size")).cast("double")
    return t.withColumn("target", F.when(F.col("fits") | (level.isNotNull() & (level * F.col("weight") <= cap)), level * F.col("weight")).otherwise(cap)).drop("level", "fits")


#: The order of a source's documents, and of all copies with the same finish time.
PLACE = ["shuffle", "doc_id", "size", "print"]
ORDER = ["finish", *KEYS, *PLACE, "copy"]


def _sized(text: str) -> list[Column]:
    """What the mix needs to know of a document."""
    shuffle = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return ["doc_id", "source", *_keys(), word_count(F.col(text)).alias("size"), shuffle.alias("shuffle"), F.xxhash64(text).alias("print")]


class Mix:
    """A mix of ``docs``; ``places`` has no texts: one row per document with its order in its source."""

    def __init__(self, docs: DataFrame, share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS, text: str = "text"):
        self.repeats, self.share = repeats, share
        sized = materialise(docs.select(*_sized(text)), "mix-sizes")
        self.ranges = max(1, math.isqrt(sized.count()))
        by_part = self.spread(sized).groupBy(*KEYS, "part").agg(F.sum("size").alias("words"))
        by_part = by_part.withColumn("start", F.sum("words").over(Window.partitionBy(*KEYS).orderBy("part")) - F.col("words"))
        sources = source_targets(by_part.groupBy(*KEYS).agg(F.sum("words").alias("source_size")), share, repeats, weights)
        #: Per hash range of a source: the words before it, and the source's size and target.
        self.starts = materialise(by_part.drop("words").join(sources, KEYS), "mix-starts")
        self.places = materialise(self.placed(sized).select("doc_id", "source", *KEYS, "size", "shuffle", "print", "source_size", "target", "upto"), "mix-places")
        self.total = self.places.agg(F.sum("size")).first()[0] or 0
        self.budget = self.total * share
        discard(docs.sparkSession, sized)

    def spread(self, sized: DataFrame) -> DataFrame:
        return sized.withColumn("part", F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * self.ranges / F.lit(1 << 32)))

    def placed(self, sized: DataFrame) -> DataFrame:
        """Adds to sized documents the words of their source up to and including them (``upto``)."""
        inside = Window.partitionBy(*KEYS, "part").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
        return self.spread(sized).join(self.starts, [*KEYS, "part"]).withColumn("upto", F.col("start") + F.sum("size").over(inside))

    def finish(self, copy: Column) -> Column:
        """Virtual finish time of a copy (0, 1, ...) of a document; null where the source has no words."""
        return F.when(F.col("target") > 0, (copy * F.col("source_size") + F.col("upto")) / F.col("target"))

    def copies(self, placed: DataFrame) -> DataFrame:
        """Every copy of every document that has words, with its finish time."""
        copies = placed.where(F.col("size") > 0).withColumn("copy", F.explode(F.array(*map(F.lit, range(self.repeats)))))
        return copies.withColumn("finish", self.finish(F.col("copy"))).where(F.col("finish").isNotNull())

    def order(self) -> DataFrame:
        """The mixed order: one row per copy taken, with its finish time, the words before it (``at``) and those taken of it."""
        copies = self.copies(self.places).withColumn("slice", F.floor(F.col("finish") * self.ranges))
        by_slice = copies.groupBy("slice").agg(F.sum("size").alias("words"))
        by_slice = by_slice.withColumn("start", F.sum("words").over(Window.orderBy("slice")) - F.col("words")).where(F.col("start") < self.budget)
        inside = Window.partitionBy("slice").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        ranked = copies.join(by_slice.select("slice", "start"), "slice").withColumn("at", F.col("start") + F.sum("size").over(inside) - F.col("size"))
        taken = F.least(F.col("size").cast("double"), F.lit(float(self.budget)) - F.col("at"))
        return ranked.withColumn("taken", F.floor(taken)).where(F.col("taken") > 0).drop("slice", "start")

    def border(self) -> tuple[Column, int] | None:
        """The last copy of the mixed order, as a struct of ORDER, and the words taken of it; every copy before it is whole."""
        last = self.order().agg(F.max(F.struct(*ORDER)).alias("k"), F.max_by("taken", F.struct(*ORDER)).alias("part"))
        row = last.first()
        if row is None or row["k"] is None:
            return None
        return F.struct(*(F.lit(row["k"][f.name]).cast(f.dataType).alias(f.name) for f in last.schema["k"].dataType)), row["part"]

    def taken(self) -> DataFrame:
        """One row per document: ``taken``, the words that the mix takes of it, repeats counted."""
        border, total = self.border(), F.lit(0).cast("long")
        if border is None:
            return self.places.withColumn("taken", total)
        for copy in range(self.repeats):
            own = F.struct(self.finish(F.lit(copy)).alias("finish"), *KEYS, *PLACE, F.lit(copy).alias("copy"))
            words = F.when(own < border[0], F.col("size")).when(own == border[0], F.lit(border[1])).otherwise(0)
            total = total + F.when((F.col("size") > 0) & (F.col("target") > 0), words).otherwise(0)
        return self.places.withColumn("taken", total.cast("long"))


def mix_documents(docs: DataFrame, share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS, text: str = "text") -> DataFrame:
    """The documents that the mix takes, each as often as it takes it (a part counts as a time), with their own columns, in the mixed order.

    Texts move twice: to their source's hash range, and to their place in the order.
    """
    mix = Mix(docs, share, repeats, weights, text)
    border = mix.border()
    if border is None:
        return docs.limit(0)
    whole = docs.select(F.struct(*docs.columns).alias("_document"), *_sized(text))
    copies = mix.copies(mix.placed(whole)).where(F.struct(*ORDER) <= border[0])
    return copies.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("_document.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return Mix(docs).taken().select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key, md5(coalesce(doc_id::VARCHAR, '')) AS shuffle,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY no_source, source_key) - 1) % 3] AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER b, 0) AS left_words,
        sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight FROM w
      WINDOW b AS (ORDER BY source_size / weight, weight, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, left_words::DOUBLE / left_weight::DOUBLE AS level FROM r),
v AS (SELECT arg_min(level, (source_size / weight, weight, no_source, source_key)) FILTER (WHERE level * weight <= 2 * source_size) AS level FROM l),
t AS (SELECT w.*, least(v.level * weight, (2 * source_size)::DOUBLE) AS target FROM w, v),
p AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY no_source, source_key ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t USING (no_source, source_key)),
c AS (SELECT p.*, copy, (copy * source_size + upto)::DOUBLE / target AS finish FROM p, (SELECT unnest([0, 1]) AS copy) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, no_source, source_key, shuffle, doc_id, size, copy ROWS UNBOUNDED PRECEDING) - size AS words_before FROM c),
k AS (SELECT doc_id, sum(floor(greatest(0, least(size::DOUBLE, (SELECT sum(size) FROM d) * 1.5::DOUBLE - words_before)))) AS taken FROM o GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size::BIGINT AS source_size, p.target, coalesce(k.taken, 0)::BIGINT AS taken FROM p LEFT JOIN k ON p.doc_id = k.doc_id
"""

QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {"op3_mixing": ORACLE}
