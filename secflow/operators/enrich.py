"""Threat intelligence and asset enrichment: joins against reference tables.

Indicator tables may be large: exact lookups are plain equi-joins, and network lookups are
equi-joins on the first bits for each prefix length there is, so neither needs a broadcast.
Pattern dimensions (assets, accounts) are joined by equality too: whole patterns, and the
plain start or end of globs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.functions.net import first_bits, hex4, hex6
from secflow.functions.predicates import glob_regex

#: Verdicts from best to worst.
VERDICTS = ("unknown", "benign", "suspicious", "anonymizer", "malicious")
LEVEL_SCORES = {"low": 3, "medium": 5, "high": 8, "critical": 10}
#: Globs of one expression; more are tried step after step.
GLOBS = 500


def verdict_rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)


def match_indicators(values: DataFrame, indicators: DataFrame) -> DataFrame:
    """Distinct values with the indicator of the same value, if any."""
    return values.select("value").distinct().join(indicators, "value", "left")


def addresses(text: Column) -> Column:
    """(version, digits) of an address of either version; null for any other text."""
    four, six = hex4(text), hex6(text)
    return F.when(four.isNotNull(), F.struct(F.lit(4).alias("version"), four.alias("digits"))).when(six.isNotNull(), F.struct(F.lit(6).alias("version"), six.alias("digits")))


def match_networks(values: DataFrame, networks: DataFrame) -> DataFrame:
    """Each address with the first network (by ``ordinal``) of its version that contains it; addresses in none are absent.

    A network is one row, whatever its size: its version, length and first bits. An address
    asks once for each length that any network has (161 at most), by an equi-join.
    """
    base, length = F.substring_index("cidr", "/", 1), F.substring_index("cidr", "/", -1).try_cast("int")
    whole = F.when(F.col("cidr").contains("/"), length).otherwise(F.when(F.col("cidr").contains(":"), 128).otherwise(32))
    nets = networks.withColumn("_a", addresses(base)).withColumn("bits", whole).where("_a IS NOT NULL AND bits BETWEEN 0 AND CASE _a.version WHEN 4 THEN 32 ELSE 128 END")
    nets = nets.select(F.col("_a.version").alias("version"), "bits", first_bits(F.col("_a.digits"), F.col("bits")).alias("prefix"), "cidr", "verdict", "score", "ordinal")
    lengths = nets.groupBy("version").agg(F.collect_set("bits").alias("lengths"))  # two rows
    own = values.select("value").distinct().withColumn("_a", addresses(F.col("value"))).where("_a IS NOT NULL").select("value", "_a.*")
    asked = own.join(F.broadcast(lengths), "version").withColumn("bits", F.explode("lengths"))
    met = asked.withColumn("prefix", first_bits(F.col("digits"), F.col("bits"))).join(nets, ["version", "bits", "prefix"])
    return met.groupBy("value").agg(F.min_by("cidr", "ordinal").alias("cidr"), F.min_by("verdict", "ordinal").alias("verdict"), F.min_by("score", "ordinal").alias("score"))


def merge_verdicts(answers: DataFrame) -> DataFrame:
    """Several answers on a value to one: worst verdict, highest score, all categories, the first known country."""
    rank = verdict_rank(F.col("verdict"))
    worst = F.max(rank)
    categories = F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories"))))
    merged = answers.groupBy("value").agg(F.element_at(F.array(*map(F.lit, VERDICTS)), worst.cast("int")).alias("verdict"), F.max("score").alias("score"), categories.alias("categories"), F.min_by("country", F.when(F.col("country").isNotNull(), F.col("ordinal"))).alias("country"), F.bool_or("internal").alias("internal"))
    return merged.withColumn("verdict", F.when(F.col("internal") & (F.col("verdict") == "unknown"), "benign").otherwise(F.col("verdict")))


def first_pattern(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, level) of the first pattern that fits: an exact one, else by ``ordinal``. ``patterns``: regex, pattern, level, ordinal.

    A glob that starts with plain text is met by an equi-join on that text, one that only ends
    with plain text by a join on its end; a value asks once for each length that such texts
    have. Only globs with a wildcard at both ends are tried on every value, GLOBS at a time.
    """
    own = values.select("value").where("value IS NOT NULL").distinct()
    low = F.lower("value")
    exact = patterns.groupBy(F.lower("pattern").alias("_own")).agg(F.min_by("level", "ordinal").alias("level"))
    globs = patterns.where(F.col("pattern").rlike("[*?]") & F.col("level").isNotNull())
    head, tail = (F.lower(F.regexp_extract("pattern", r, 0)) for r in (r"^[^*?\\]*", r"[^*?\\]*$"))
    sided = globs.withColumn("_side", F.when(head != "", "head").when(tail != "", "tail")).withColumn("_text", F.when(head != "", head).otherwise(tail))
    keyed = sided.where("_side IS NOT NULL").select("_side", F.length("_text").alias("_n"), "_text", "regex", "level", "ordinal")
    lengths = keyed.groupBy("_side").agg(F.collect_set("_n").alias("_lengths"))  # two rows
    asked = own.join(F.broadcast(lengths)).withColumn("_n", F.explode("_lengths")).where(F.length(low) >= F.col("_n"))
    asked = asked.select("value", "_side", "_n", F.when(F.col("_side") == "head", F.left(low, F.col("_n"))).otherwise(F.right(low, F.col("_n"))).alias("_text"))
    met = asked.join(keyed, ["_side", "_n", "_text"]).where(F.rlike(low, F.col("regex"))).groupBy("value").agg(F.min(F.struct("ordinal", "level")).alias("_met"))
    rest = sided.where("_side IS NULL").orderBy("ordinal").select("regex", "level", "ordinal").collect()  # globs without a plain end
    out = own.join(exact, low == F.col("_own"), "left").drop("_own").join(met, "value", "left")
    kind = met.schema["_met"].dataType
    out = out.withColumn("_rest", F.lit(None).cast(kind))
    for at in range(0, len(rest), GLOBS):
        hits = [F.when(low.rlike(g["regex"]), F.struct(F.lit(g["ordinal"]).alias("ordinal"), F.lit(g["level"]).alias("level")).cast(kind)) for g in rest[at : at + GLOBS]]
        out = out.withColumn("_rest", F.coalesce("_rest", *hits))
    return out.select("value", F.coalesce("level", F.least("_met", "_rest")["level"]).alias("level")).where("level IS NOT NULL")


def pattern_table(df: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    """A pattern dimension from (glob, level) pairs in order."""
    return df.sparkSession.createDataFrame([(glob_regex(p), p, level, i) for i, (p, level) in enumerate(rows)], "regex string, pattern string, level string, ordinal int")


def level_score(level: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for item in LEVEL_SCORES.items() for x in item))[level], F.lit(5))


def prune(indicators: DataFrame, now: int, days: int) -> DataFrame:
    """Indicators not older than ``days`` by expiry, else by update, in microseconds."""
    return indicators.where(F.coalesce("expires_at", "updated_at") >= now - days * 86_400_000_000)
