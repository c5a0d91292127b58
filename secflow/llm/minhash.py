"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full sets.

1. Each text becomes its set of 5-word shingles (64-bit hashes), the set's size, a 128-bit
   fingerprint and a signature of ``TREES * DEPTH`` MinHash values. Documents with equal
   fingerprints are one class; only classes go on.
2. Forest: each tree orders the classes by its own DEPTH values of the signature. Classes
   with a common prefix of LEAST values are a region of that order. A region of more than
   REGION classes is cut by the next value, and its parts again, as deep as each needs, down
   to the whole key; so every class has its own depth in every tree. The neighbours in a
   region's sorted order, whose longest common prefix with a class has at least the region's
   depth, are its candidates, if the whole signatures agree on enough values. A region that
   is crowded at full depth is taken whole, without listing its pairs.
3. Candidates form families (connected components). The sets of a family that fits a block
   are compared with one another, exactly. In a larger one all sets are first compared with
   one of them, the pivot, in blocks. Those linked with it are one component already; the
   rest is compared with every member that the triangle inequality of the Jaccard distance
   leaves: a link is impossible where the distances to the pivot differ by more than a
   link's. So a family of near copies costs as many comparisons as it has members, no block
   holds more than about BLOCK sets or BLOCK_SHINGLES shingles a side, and no partner or
   candidate is dropped.
4. The links' components are the result.

At similarity 0.85 two sets share a whole key of 8 values in some of 32 trees with
probability 1 - 4e-5, and a prefix of 5 with 1 - 2e-8; the signature test (0.70 on 256
values) loses fewer.

Rows: null and empty texts, or texts without words, have an empty set and are linked with
nothing; shorter texts than 5 words are one shingle. Texts are read whole. Repeated rows
with one id are one document: they get the same values. A row without an id belongs to its
class but names none: its component is the smallest id of the class, or null if it has
none, and then it is kept. Columns other than the text pass through, same-named ones are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.llm.common import discard, materialise, read
from secflow.llm.graph import components

WORDS = 5
TREES, LEAST, DEPTH = 32, 5, 8
HASHES = TREES * DEPTH
#: Most classes of a region whose pairs are listed; least agreement of signatures; classes and shingles of a block.
REGION, AGREE, BLOCK, BLOCK_SHINGLES = 32, 0.70, 256, 1 << 19
#: Distances to a pivot are told apart by bands of this width.
BAND = 0.05
PIECE = 1 << 20
_rng = np.random.default_rng(20240607)
_MULTIPLIER, _ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = [np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    """0th to (n-1)th power of the base."""
    if len(_powers[0]) < n:
        _powers[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * len(_powers[0])), _BASE)]))
    return _powers[0]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, in order."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    x = np.frombuffer(raw, np.uint8)
    space = _SPACE[x]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    found, at = [], 0
    while at < len(starts):
        # Whole words of about PIECE bytes; one longer word is a piece of its own.
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        s, e = starts[at:to], ends[at:to]
        lengths = e - s
        index = np.arange(int(lengths.sum()), dtype=np.int64)
        firsts = np.cumsum(lengths) - lengths
        inside = index - np.repeat(firsts, lengths)
        values = (x[np.repeat(s, lengths) + inside].astype(np.uint64) + np.uint64(1)) * _power(int(lengths.max()))[inside]
        found.append(_mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64)))
        at = to
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = word_hashes(text or "")
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        h = np.uint64(n)
        with np.errstate(over="ignore"):
            for w in words:
                h = _mix(h * _BASE + w)
        return np.array([h], np.uint64)
    h = np.full(n - WORDS + 1, WORDS, np.uint64)
    for i in range(WORDS):
        h = _mix(h * _BASE + words[i : n - WORDS + 1 + i])
    return np.unique(h)


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(np.add.reduce(_mix(own)).astype(np.int64)), int(np.bitwise_xor.reduce(_mix(own * _BASE + np.uint64(1))).astype(np.int64))


def signature(own: np.ndarray) -> np.ndarray:
    """16 bits of each of the HASHES minima of a set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        part = np.multiply.outer(_MULTIPLIER, x[at : at + 1024])
        part += _ADD[:, None]
        np.minimum(low, part.min(1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def tree_keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each tree's key of every signature: a hash of the tree and its first LEAST values, and the other values as one number, first value highest."""
    parts = sig.reshape(-1, TREES, DEPTH).astype(np.uint64)
    top = np.broadcast_to(np.arange(TREES, dtype=np.uint64), parts.shape[:2])
    for i in range(LEAST):
        top = _mix(top * _BASE + parts[:, :, i])
    tail = np.zeros(parts.shape[:2], np.uint64)
    for i in range(LEAST, DEPTH):
        tail = tail << np.uint64(16) | parts[:, :, i]
    return top.view(np.int64), tail.view(np.int64)


CLASS = ["n_shingles", "f1", "f2"]


def sketches_of(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without texts, with each text's set size, fingerprint and signature."""
    rest = [c for c in docs.columns if c not in (text, "doc_id", *CLASS, "sig", "component_id", "kept")]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(t.as_py()) for t in batch.column(batch.num_columns - 1))
            rows = [(len(s), *fingerprint(s), signature(s).tobytes() if len(s) else None) for s in sets]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], ["doc_id", *rest, *CLASS, "sig"])

    added = [T.StructField(c, T.LongType()) for c in CLASS] + [T.StructField("sig", T.BinaryType())]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(docs.schema[c] for c in rest), *added])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *rest, text).mapInArrow(sketch, schema)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        top, tail = tree_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, TREES)), pa.array(top.reshape(-1)), pa.array(tail.reshape(-1))], ["id", "top", "tail"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
        keep = pa.array((one == two).mean(1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _neighbours(regions: DataFrame) -> DataFrame:
    """Pairs (a < b) of the classes of every region, in its sorted order."""
    grouped = regions.groupBy("top", "prefix").agg(F.sort_array(F.collect_list(F.struct("tail", "id"))).alias("own"))
    pairs = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")))))
    return grouped.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are the families; ``classes``: id and signature of each class."""
    spark = classes.sparkSession
    rest = classes.select("id", "sig").mapInArrow(_entries, "id long, top long, tail long")
    listed, whole, held = [], [], []
    for depth in range(LEAST, DEPTH + 1):
        cut = rest.withColumn("prefix", F.shiftright("tail", 16 * (DEPTH - depth)))
        sizes = cut.groupBy("top", "prefix").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first")).where("members > 1")
        regions = materialise(cut.join(sizes, ["top", "prefix"]), "regions")
        held.append(regions)
        listed.append(_neighbours(regions.where(F.col("members") <= REGION)))
        crowded = regions.where(F.col("members") > REGION)
        if crowded.isEmpty():
            break
        if depth == DEPTH:
            whole.append(crowded.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))
        rest = crowded.select("id", "top", "tail")
    pairs = functools.reduce(DataFrame.union, listed).distinct()
    sig = lambda c: classes.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    tested = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing, "a long, b long")
    edges = materialise(functools.reduce(DataFrame.union, whole, tested), "candidates")
    discard(spark, *held)
    return edges


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, exactly."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1  # hashes of one set alone add nothing
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    found = np.zeros((m, m), np.float32)
    width = max(1, (1 << 22) // m)
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if e > s:
            part = np.zeros((m, width), np.float32)
            part[owner[s:e], column[s:e] - k * width] = 1
            found += part @ part.T
    return found.astype(np.int64)


def block_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the rows (of the two sides, if there are two)."""
    sizes = np.array([len(s) for s in sets])
    shared = overlaps(sets)
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    if len(np.unique(sides)) > 1:
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, False)
    root, found = -np.ones(len(ids), int), []
    for start in range(len(ids)):
        if root[start] >= 0:
            continue
        root[start], queue = start, [start]
        while queue:
            at = queue.pop()
            for to in np.flatnonzero(linked[at] & (root < 0)):
                root[to] = start
                found.append((int(ids[at]), int(ids[to])))
                queue.append(int(to))
    return found


def full_sets(docs: DataFrame, members: DataFrame, classes: DataFrame, text: str) -> DataFrame:
    """(id, own, ...) of every class in ``members``: its set of shingle hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingles(t.as_py()) for t in batch.column(1)]
            prints = [fingerprint(s) for s in rows]
            columns = [pa.array([len(s) for s in rows], pa.int64()), *(pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([s.tobytes() for s in rows], pa.binary())], ["id", *CLASS, "own"])

    wanted = members.join(classes.select("id", "f1", "f2"), "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text).join(members.select("id"), "id", "left_semi")
    # An id on several rows may carry several texts: only its class's set counts.
    return texts.mapInArrow(sets, "id long, n_shingles long, f1 long, f2 long, own binary").join(wanted, ["id", *CLASS]).drop("f1", "f2")


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def family_links(placed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all links within families; ``placed``: id, own, n_shingles, family, pivot, blocks."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "side"])
        found = block_links(pdf["id"].to_numpy(), pdf["side"].to_numpy(), _sets(pdf["own"]), percent)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    def with_pivot(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["is_pivot"].to_numpy()
        pivot, rest = np.frombuffer(pdf["own"][first].iloc[0], np.uint64), pdf[~first]
        shared = np.array([np.count_nonzero(np.isin(s, pivot, assume_unique=True)) for s in _sets(rest["own"])], np.int64)
        joint = rest["n_shingles"].to_numpy() + len(pivot) - shared
        return pd.DataFrame({"id": rest["id"], "family": rest["family"], "pivot": rest["pivot"], "linked": 100 * shared >= percent * joint, "band": np.floor((1 - shared / joint) / BAND).astype(np.int32)})

    whole = placed.where("blocks = 1").withColumn("side", F.lit(0)).groupBy("family").applyInPandas(compare, "a long, b long")
    large = placed.where("blocks > 1").select("id", "own", "n_shingles", "family", "pivot", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("is_pivot"))
    if large.isEmpty():
        return materialise(whole, "links")
    pivots = large.where("id = pivot").dropDuplicates(["id"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("is_pivot", F.lit(True))
    seen = large.unionByName(pivots).groupBy("family", "block").applyInPandas(with_pivot, "id long, family long, pivot long, linked boolean, band int")
    seen = materialise(seen.distinct(), "pivot-distances")
    links = whole.union(seen.where("linked AND id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    # The others against all members that their distance to the pivot doesn't rule out, block by block.
    sizes = placed.where("blocks > 1").select("id", "n_shingles").dropDuplicates(["id"])
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    others, reach = seen.where("NOT linked"), int(np.ceil((1 - percent / 100) / BAND)) + 1

    def blocks(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The members' block (band, part), and all blocks of a family."""
        counted = rows.join(sizes, "id").groupBy("family", "band").agg(parts.alias("parts"))
        own = rows.join(counted, ["family", "band"]).select("id", "family", F.col("band").alias(f"{name}_band"), F.pmod(F.xxhash64(F.lit(name), "id"), F.col("parts")).cast("int").alias(f"{name}_part"))
        return own, counted.select("family", F.col("band").alias(f"{name}_band"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"{name}_part"))

    asking, asked = blocks(others, "one"), blocks(seen.join(others.select("family").distinct(), "family", "left_semi"), "two")
    near = F.abs(F.col("one_band") - F.col("two_band")) <= reach
    key = ["family", "one_band", "one_part", "two_band", "two_part"]
    spread = asking[0].join(asked[1], "family").where(near).select("id", *key, F.lit(0).alias("side")).unionByName(asked[0].join(asking[1], "family").where(near).select("id", *key, F.lit(1).alias("side")))
    pairs = spread.join(placed.select("id", "own"), "id").groupBy(*key).applyInPandas(compare, "a long, b long")
    found = materialise(links.union(pairs), "links")
    discard(placed.sparkSession, seen)
    return found


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text") -> DataFrame:
    """``docs`` without texts, with ``n_shingles``, ``component_id`` and ``kept``."""
    spark = docs.sparkSession
    sketches = materialise(sketches_of(docs, text), "sketches")
    filled = sketches.where("n_shingles > 0")
    classes = materialise(filled.groupBy(*CLASS).agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")).where("id IS NOT NULL"), "classes")
    candidates = candidate_edges(classes)
    families = components(candidates).withColumnRenamed("component", "family").join(classes.select("id", "n_shingles"), "id")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = families.groupBy("family").agg(blocks.alias("blocks"), F.min("id").alias("pivot"))
    members = materialise(families.join(sizes, "family"), "families")
    placed = materialise(full_sets(docs, members, classes, text), "family-sets")
    links = family_links(placed, percent)
    discard(spark, candidates, members, placed)
    reached = components(links).select("id", F.col("component").alias("reached"))
    resolved = classes.select(*(F.col(c).alias(f"_{c}") for c in CLASS), "id").join(reached, "id", "left").select(*(f"_{c}" for c in CLASS), F.coalesce("reached", "id").alias("component_id"))
    rest = [c for c in sketches.columns if c not in ("doc_id", *CLASS, "sig")]
    found = sketches.join(resolved, [F.col(c) == F.col(f"_{c}") for c in CLASS], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return found.select("doc_id", *rest, "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents whose id is their component's smallest, with their own columns."""
    gone = near_duplicates(docs, percent).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS id, count(*) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
e AS (SELECT id, len(s) AS size, unnest(s) AS h FROM c WHERE len(s) > 0),
p AS (SELECT x.id AS a, y.id AS b, x.size AS sa, y.size AS sb, count(*) AS common FROM e x JOIN e y ON x.h = y.h AND x.id < y.id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (sa + sb - common)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (SELECT id, id FROM c UNION SELECT r.id, b.b FROM r JOIN both_ways b ON r.reach = b.a),
m AS (SELECT id, min(reach) AS component FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE m.component END AS component_id,
       CASE WHEN len(s.s) = 0 THEN true ELSE s.doc_id = m.component END AS kept
FROM s JOIN c ON list_sort(s.s) = c.s JOIN m ON c.id = m.id
"""

QUERIES = {"op2_near_duplicates": op2_near_duplicates}
ORACLES = {"op2_near_duplicates": ORACLE}
