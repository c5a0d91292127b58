"""A Merkle manifest of a dataset: one digest for all rows, and a proof for each row.

Every row becomes a leaf, the digest of its fields. The rows of a group (a language) ascend
by their key, each run of ``fanout`` consecutive nodes becomes the digest of its members'
digests, level by level, until one node, the group's subroot, remains; the groups' subroots
give the root in the same way. A row's proof is the list of its siblings on the way up.

Method: a leaf's rank within its group is written as digits. Leaves are dealt into blocks of
``fanout ** digits`` ranks, and inside a block the digit columns are grouped away one after
another, from the last, each time nesting the child structs in their parent's. All of that
happens after one shuffle by block, as streaming sorted aggregates. The blocks' digests are
the nodes of the next level of blocks, until every group has one block, and then the groups
themselves are rolled up. On the way down each block's nested struct is unrolled by
transforms, which collect the siblings, and exploded: leaves meet their siblings without a
join. Only whole blocks join with their own proofs, one row a block.

Bounds: a block holds ``fanout ** digits`` nodes (256), whatever its group's size; ranks come
from range counts. Nested blocks are written to the shared folder, so a lost executor costs
one level at most.

Rows: nulls are fields of their own (``-``), a null group is a group of its own and comes
first, a null key comes first in its group. Rows of one key are ordered by their leaves;
equal rows are leaves of their own, with proofs of their own. Only the columns named are
read, so other columns cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.llm.common import crc32_of_id, discard, materialise, read
from secflow.llm.ranks import numbered

STEPS = "array<struct<at: int, others: array<string>>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """The digest of fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    held = [f.cast("string") for f in fields]
    return digest(F.concat(*(F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in held)))


def joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def fold(start: Column, steps: Column) -> Column:
    """The digest reached from ``start`` by a proof's steps; each step gives the siblings and the place among them."""
    return F.aggregate(steps, start, lambda h, s: digest(F.concat(joined(F.slice(s["others"], 1, s["at"])), h, joined(F.slice(s["others"], s["at"] + 1, F.size(s["others"]))))))


def siblings(steps: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.flatten(F.transform(steps, lambda s: s["others"]))


@dataclass
class Rollup:
    """Trees rolled up: ``levels`` are tables of (tree, block, n, node), each the blocks of the nodes below."""

    levels: list[DataFrame]
    fanout: int
    digits: int

    @property
    def roots(self) -> DataFrame:
        """(tree, hash): one row per tree."""
        return self.levels[-1].select("tree", F.col("node.hash").alias("hash"))

    def unrolled(self, above: DataFrame) -> DataFrame:
        """(kept, hash, steps, and the other columns of ``above``) of every leaf. ``above``: tree and ``steps``, its own proof, one row per tree."""
        carried = [c for c in above.columns if c not in ("tree", "steps")]
        rows = above.withColumn("block", F.lit(0).cast("long"))
        for level in reversed(self.levels):
            met = level.join(rows, ["tree", "block"])
            # From the block's root down: every step replaces nodes by their children, each with its siblings put before the steps so far.
            at = F.array(F.struct(F.col("node"), F.array().cast(STEPS).alias("steps")))
            for i in reversed(range(self.digits)):
                at = self._children(at, F.col("n") > F.lit(self.fanout**i))
            rows = met.select("tree", *carried, F.col("steps").alias("_up"), F.explode(at).alias("x"))
            rows = rows.select("tree", *carried, F.col("x.node.kept").alias("kept"), F.col("x.node.hash").alias("hash"), F.concat("x.steps", "_up").alias("steps"))
            if level is not self.levels[0]:
                rows = rows.select("tree", *carried, F.col("kept.pos").alias("block"), "steps")
        return rows

    @staticmethod
    def _children(nodes: Column, real: Column) -> Column:
        def one(x: Column) -> Column:
            def child(kid: Column, place: Column) -> Column:
                others = F.transform(F.filter(x["node"]["kids"], lambda _, i: i != place), lambda k: k["hash"])
                step = F.array(F.struct(place.cast("int").alias("at"), others.alias("others")))
                return F.struct(kid.alias("node"), F.when(real, F.concat(step, x["steps"])).otherwise(x["steps"]).alias("steps"))

            return F.transform(x["node"]["kids"], child)

        return F.flatten(F.transform(nodes, one))


def _blocks(nodes: DataFrame, fanout: int, digits: int) -> DataFrame:
    """(tree, block, n, node) of nodes (tree, pos, n, hash, kept): the digits of ``pos`` grouped away within their block."""
    size = fanout**digits
    digit = [F.pmod(F.floor(F.col("pos") / F.lit(fanout**i)), F.lit(fanout)).cast("int").alias(f"d{i}") for i in range(digits)]
    rows = nodes.select("tree", F.floor(F.col("pos") / F.lit(size)).cast("long").alias("block"), "n", *digit, F.struct("hash", "kept").alias("node"))
    order = ["tree", "block", "n", *(f"d{i}" for i in reversed(range(digits)))]
    rows = rows.repartition("tree", "block").sortWithinPartitions(*order)
    for i in range(digits):
        kids = [F.first(F.when(F.col(f"d{i}") == j, F.col("node")), ignorenulls=True).alias(f"k{j}") for j in range(fanout)]
        rows = rows.groupBy(*order[: len(order) - 1 - i]).agg(*kids)
        rows = rows.withColumn("kids", F.filter(F.array(*(f"k{j}" for j in range(fanout))), lambda k: k.isNotNull()))
        # A tree of at most fanout ** i nodes is done by now: its node stays as it is.
        up = F.when(F.col("n") > F.lit(fanout**i), digest(joined(F.transform("kids", lambda k: k["hash"])))).otherwise(F.col("kids")[0]["hash"])
        rows = rows.select(*order[: len(order) - 1 - i], F.struct(up.alias("hash"), F.col("kids")).alias("node"))
    return rows


def roll_up(leaves: DataFrame, order: list[str], fanout: int = 2, digits: int = 8) -> Rollup:
    """Rolls up leaves (tree, hash, kept, and the columns of ``order``); ``kept`` is a struct that comes out again with the proofs."""
    ranked = numbered(leaves, ["tree"], order, "merkle-leaves")
    nodes, levels = ranked.select("tree", "pos", "n", "hash", "kept"), []
    while True:
        levels.append(materialise(_blocks(nodes, fanout, digits), "merkle-blocks"))
        if not levels[-1].agg(F.max("block")).first()[0]:
            break
        nodes = levels[-1].select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(fanout**digits)).cast("long").alias("n"), F.col("node.hash").alias("hash"), F.struct(F.col("block").alias("pos")).alias("kept"))
    discard(leaves.sparkSession, ranked)
    return Rollup(levels, fanout, digits)


def manifest(rows: DataFrame, group: str, key: str, fields: list[str], fanout: int = 2, digits: int = 8, **more: Column) -> DataFrame:
    """One row per row of ``rows``: its key, ``leaf``, ``steps`` (its proof), ``subroot``, ``root`` and the columns of ``more``.

    ``fields`` go into the leaf in that order. ``more`` are Columns over ``rows``, carried along.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all others, which keep their order
    kept = F.struct(F.col(key).alias("key"), *(c.alias(n) for n, c in more.items()))
    leaves = rows.select(tree.alias("tree"), leaf_of(*map(F.col, fields)).alias("hash"), kept.alias("kept"), F.monotonically_increasing_id().alias("salt"))
    leaves = materialise(leaves.withColumn("key", F.col("kept.key")), "merkle-hashes")
    # Equal rows may take each other's places, so what tells them apart need not agree between runs; it spreads them over ranges.
    docs = roll_up(leaves, ["key", "hash", "salt"], fanout, digits)
    groups = docs.roots.select(F.lit("").alias("tree"), "hash", F.struct(F.col("tree").alias("tree"), F.col("hash").alias("subroot")).alias("kept"), F.col("tree").alias("name"))
    whole = roll_up(groups, ["name"], fanout, digits)
    top = whole.roots.select("tree", F.col("hash").alias("root"), F.array().cast(STEPS).alias("steps"))
    above = materialise(whole.unrolled(top).select("kept.tree", "kept.subroot", "root", "steps"), "merkle-groups")
    discard(rows.sparkSession, leaves, *whole.levels)
    proofs = docs.unrolled(above)
    return proofs.select(F.col("kept.key").alias(key), F.col("hash").alias("leaf"), "steps", "subroot", "root", *(F.col(f"kept.{n}").alias(n) for n in more))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    changed = leaf_of(*((F.col(f).cast("decimal(20,0)") + 1) if f == "n_chars" else F.col(f) for f in FIELDS))
    found = manifest(docs, "lang", "doc_id", FIELDS, tampered=F.when(F.pmod(crc32_of_id(), F.lit(7)) == 0, changed))
    folded = fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    found = found.select("doc_id", "leaf", "subroot", "root", digest(joined(siblings(F.col("steps")))).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a text in DuckDB: the bytes one by one, eight shifts each, with the polynomial's reversed bits. Texts here are ASCII.
CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"

_FIELD = "CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f}::VARCHAR END"
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({" || ".join(_FIELD.format(f=f) for f in FIELDS)}) AS leaf,
         sha256({" || ".join(_FIELD.format(f="(n_chars + 1)" if f == "n_chars" else f) for f in FIELDS)}) AS changed,
         {CRC32.format(x="doc_id::VARCHAR")} % 7 = 0 AS tamper FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (
  SELECT tree, 0 AS level, pos, n, leaf AS h FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 2, n),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
walk AS (
  SELECT tree, pos AS leaf_pos, pos, 0 AS level, n, CASE WHEN tamper THEN changed ELSE leaf END AS h, '' AS proof FROM l
  UNION ALL
  SELECT w.tree, w.leaf_pos, w.pos // 2, w.level + 1, (w.n + 1) // 2,
         sha256(CASE WHEN w.pos % 2 = 0 THEN w.h || coalesce(u.h, '') ELSE u.h || w.h END), w.proof || coalesce(u.h, '')
  FROM walk w LEFT JOIN up u ON u.tree = w.tree AND u.level = w.level AND u.pos = xor(w.pos, 1) WHERE w.n > 1),
walk2 AS (
  SELECT w.tree, w.leaf_pos, s.pos, 0 AS level, s.n, w.h, w.proof FROM walk w JOIN s USING (tree) WHERE w.n = 1
  UNION ALL
  SELECT w.tree, w.leaf_pos, w.pos // 2, w.level + 1, (w.n + 1) // 2,
         sha256(CASE WHEN w.pos % 2 = 0 THEN w.h || coalesce(u.h, '') ELSE u.h || w.h END), w.proof || coalesce(u.h, '')
  FROM walk2 w LEFT JOIN top u ON u.level = w.level AND u.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM l JOIN s USING (tree) JOIN walk2 w ON w.tree = l.tree AND w.leaf_pos = l.pos AND w.n = 1, (SELECT h FROM top WHERE n = 1) r
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {"op11_merkle_manifest": ORACLE}
