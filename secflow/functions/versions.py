"""Sortable version keys and range constraints, all as column expressions.

A version is a release and, behind its first dash, a pre-release; each is a list of numbers
and words, and missing ones count as zero, however many. A pre-release sorts before its
release, build metadata is ignored. A key is a struct that compares like that field by
field: zeros inside a list become one token that says how many they are and whether what
follows is above or below zero, and a last token stands for the zeros that never end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from secflow.functions.columns import once

#: Order of pre-release words; any other word sorts after numbers.
PRE_RANKS = {"dev": -5, "alpha": -4, "a": -4, "beta": -3, "b": -3, "rc": -2, "pre": -2, "preview": -2, "snapshot": -2}
TOKEN = "struct<rank:int,size:int,word:string,side:int,zeros:int>"
EVERYTHING = ("*", "any")


def _token(rank: Column, size: Column, word: Column, side: Column, zeros: Column) -> Column:
    return F.struct(rank.cast("int").alias("rank"), size.cast("int").alias("size"), word.alias("word"), side.cast("int").alias("side"), zeros.cast("int").alias("zeros"))


def _tokens(text: Column, endless: bool = True) -> Column:
    """The numbers and words of a text as comparable tokens; ``endless`` adds the zeros behind the last one."""
    zero, none = F.lit(0), F.array().cast(f"array<{TOKEN}>")
    ranks = F.create_map(*(F.lit(x) for item in PRE_RANKS.items() for x in item))
    start = F.struct(none.alias("done"), zero.alias("zeros"))

    def add(state: Column, part: Column) -> Column:
        number = part.rlike("^[0-9]")
        digits = F.when(number, F.regexp_replace(part, "^0+", "")).otherwise("")
        rank = F.when(number, zero).otherwise(F.coalesce(ranks[part], F.lit(1)))
        # Numbers compare by how many digits they have, then digit by digit: no number is too long.
        own = _token(rank, F.length(digits), F.when(number, digits).otherwise(part), zero, zero)
        run = F.when(state["zeros"] > 0, F.array(_token(zero, zero, F.lit(""), F.when(rank < 0, -1).otherwise(1), F.when(rank < 0, state["zeros"]).otherwise(-state["zeros"])))).otherwise(none)
        return F.when(number & (digits == ""), F.struct(state["done"].alias("done"), (state["zeros"] + 1).alias("zeros"))).otherwise(F.struct(F.concat(state["done"], run, F.array(own)).alias("done"), zero.alias("zeros")))

    found = F.aggregate(F.regexp_extract_all(text, F.lit("[0-9]+|[a-z]+"), F.lit(0)), start, add)["done"]
    return F.concat(found, F.array(_token(zero, zero, F.lit(""), zero, zero))) if endless else found


def _plain(version: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(version)), r"^v+|\+.*$", "")


def _key_of(plain: Column) -> Column:
    before = F.substring_index(plain, "-", 1)
    return once(F.struct(before.alias("release"), F.substr(plain, F.length(before) + 2).alias("pre")), lambda p: F.struct(_tokens(p["release"]).alias("release"), (~p["pre"].rlike("[0-9a-z]")).alias("final"), _tokens(p["pre"]).alias("pre")))


def version_key(version: Column) -> Column:
    """The key of a version; null for null."""
    return F.when(version.isNotNull(), once(_plain(version), _key_of))


def _below(numbers: Column) -> Column:
    """A key below all versions that begin with these numbers, the last of them not zero."""
    return F.struct(_tokens(numbers, endless=False).alias("release"), F.lit(False).alias("final"), _tokens(F.lit(""), endless=False).alias("pre"))


def constraints(spec: Column) -> Column:
    """The (op, version) parts of a range; a blank or comma separates them, a blank after an operator belongs to it. Null, blank, ``*`` and ``any`` ask for nothing."""
    tight = F.regexp_replace(F.trim(F.coalesce(spec, F.lit(""))), r"(>=|<=|!=|==|~>|[<>=^~])\s+", "$1")
    parts = F.filter(F.split(tight, r"[\s,]+"), lambda x: (x != "") & ~F.lower(x).isin(*EVERYTHING))
    op = r"^(>=|<=|!=|==|~>|[<>=^~])"
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, op, 1).alias("op"), F.regexp_replace(x, op, "").alias("version")))


#: Where a bound lies among keys equal to its own: before them, or behind.
BEFORE, BEHIND = -1, 1


def limits(spec: Column) -> Column:
    """What a range asks of a version key: ``low`` and ``high``, each a (key, side) or null for none, and ``not_``, the keys left out.

    ``^`` keeps the first number, ``~`` and ``~>`` the first two.
    """
    numbers = lambda c: F.regexp_extract_all(F.substring_index(c["plain"], "-", 1), F.lit("[0-9]+"), F.lit(0))
    number = lambda c, i: F.coalesce(F.get(numbers(c), F.lit(i)).try_cast("decimal(38,0)"), F.lit(0))
    more = lambda n: (n + 1).cast("decimal(38,0)").cast("string")
    at = lambda key, side: F.struct(key.alias("key"), F.lit(side).alias("side"))

    def one(c: Column) -> Column:
        """What a single constraint asks."""
        op, key = c["op"], once(c["plain"], _key_of)
        low = F.when(op.isin(">=", "", "=", "==", "^", "~", "~>"), at(key, BEFORE)).when(op == ">", at(key, BEHIND))
        upto = F.when(op == "^", more(number(c, 0))).when(op.isin("~", "~>"), F.concat(number(c, 0).cast("string"), F.lit("."), more(number(c, 1))))
        high = F.when(op.isin("<=", "", "=", "=="), at(key, BEHIND)).when(op == "<", at(key, BEFORE)).when(upto.isNotNull(), at(_below(upto), BEFORE))
        return F.struct(low.alias("low"), high.alias("high"), F.when(op == "!=", key).alias("not_"))

    def all_(parts: Column) -> Column:
        told = lambda name: F.filter(F.transform(parts, lambda p: p[name]), lambda x: x.isNotNull())
        return F.struct(F.array_max(told("low")).alias("low"), F.array_min(told("high")).alias("high"), told("not_").alias("not_"))

    asked = F.transform(constraints(spec), lambda c: F.struct(c["op"].alias("op"), _plain(c["version"]).alias("plain")))
    return once(F.transform(asked, one), all_)


def within(key: Column, bounds: Column) -> Column:
    """Whether a version key meets the limits of a range; a version that isn't there meets none."""
    place = F.struct(key.alias("key"), F.lit(0).alias("side"))
    low = bounds["low"].isNull() | (bounds["low"] < place)
    high = bounds["high"].isNull() | (place < bounds["high"])
    return F.coalesce(key.isNotNull() & low & high & ~F.exists(bounds["not_"], lambda k: k == key), F.lit(False))


def known(version: Column) -> Column:
    """The version, null where it is empty."""
    return F.nullif(F.trim(version), F.lit(""))


def in_range(version: Column, spec: Column) -> Column:
    """Whether a version meets every constraint of a range."""
    return within(version_key(known(version)), limits(spec))


def is_fixed(version: Column, fixed: Column) -> Column:
    """Whether a version holds the published fix; without a fix, or a version, it doesn't."""
    return F.coalesce(version_key(known(version)) >= version_key(known(fixed)), F.lit(False))
