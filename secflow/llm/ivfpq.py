"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

``train`` fits coarse centroids and the residuals' sub-quantisers by k-means on a sample of
``TRAIN`` vectors, or SAMPLE for every list if that is more, ``MOST`` at most (drawn by a hash
of the id; the only vectors that reach the driver). There are as many lists as the square
root of the number of vectors. Where ``MOST`` vectors are too few for that many lists, they
are fitted on two levels: the driver's sample gives cells, and each cell's lists are fitted
by tasks of their own on its part of a sample of SAMPLE vectors a list, ``PIECE`` at a time;
only centroids come back. ``build`` assigns every vector to its list and stores its code of ``parts`` bytes,
with the distance between the vector and what the code stands for.
``search`` sends each query to its ``probes`` nearest lists (more if they hold too few rows).
``train`` sets their number so that they hold HELD of the sample's exact neighbours, and
``tuned`` sets it anew by TRIALS of the queries themselves, compared with every vector of the
index: queries may lie elsewhere than most rows do. The lists' codes are scanned with the
query's asymmetric distance table; the ``rerank`` best of every list part, and all others that
by their code's distance could still be among the nearest, are compared by the exact Euclidean
distance in double precision, and the parts' best are merged. Lists are cut into parts of about ``PART`` rows, so a list that
holds a third of all vectors is spread over many tasks.

Nearness: smallest Euclidean distance, ties to the smaller id; a query's candidates are all
rows but its own. Rows: vectors that are null, zero, hold null or non-finite components, or
differ from the most frequent length take no part (among those of one length any finite
value does: codes are made of components clipped to 1e15, distances of the original ones); rows with a null id take no part; of
rows that repeat an id only the first (by vector) is a query, and the others are candidates
like any row, for it too; of rows alike in both one is the query's own. Fewer candidates than ``k`` give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secflow.llm.common import materialise, read

#: Training sample at least, for every list, and at most; rows of a list part scanned by one task.
TRAIN, SAMPLE, MOST, PART = 20_000, 16, 1 << 18, 4096
#: Sampled rows of a cell that one task fits lists on.
PIECE = 1 << 16
PARTS, RERANK = 16, 100
#: Share of true neighbours that the probed lists should hold, and queries by which the number of probes is set.
HELD, TRIALS = 0.98, 400


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """At most k centroids of the rows; empty clusters move to the rows farthest from theirs."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(np.float32)
    for _ in range(rounds):
        own, d = nearest(x, centres)
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
        if (n == 0).any():
            far = np.argsort(-d, kind="stable")[: int((n == 0).sum())]
            centres[np.flatnonzero(n == 0)[: len(far)]] = x[far]
    return centres


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row and its squared distance, some rows at a time."""
    own, far = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    step = max(1, (1 << 23) // max(1, len(c)))
    for at in range(0, len(x), step):
        d = squared(x[at : at + step], c)
        own[at : at + step] = d.argmin(1)
        far[at : at + step] = d[np.arange(len(d)), own[at : at + step]]
    return own, far


def rough(vectors: list) -> np.ndarray:
    """Vectors as the quantiser sees them: single precision, clipped."""
    return np.clip(np.array(vectors, np.float64), -1e15, 1e15).astype(np.float32)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; squares that would overflow are scaled first."""
    rest = x.astype(np.float64) - q.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt((rest**2).sum(1))
    large = ~np.isfinite(d)
    if large.any():
        top = np.abs(rest[large]).max(1)
        d[large] = top * np.sqrt(((rest[large] / top[:, None]) ** 2).sum(1))
    return d


@dataclass(frozen=True)
class Coarse:
    """Centroids of the lists; those of cell i are ``centres[starts[i]:starts[i + 1]]`` where there are cells above them."""

    centres: np.ndarray
    cells: np.ndarray | None = None
    starts: np.ndarray | None = None

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of every row: its nearest centroid, in its nearest cell."""
        if self.cells is None:
            return nearest(x, self.centres)[0]
        cell, own = nearest(x, self.cells)[0], np.empty(len(x), np.int64)
        for c in np.unique(cell):
            rows = np.flatnonzero(cell == c)
            own[rows] = self.starts[c] + nearest(x[rows], self.centres[self.starts[c] : self.starts[c + 1]])[0]
        return own


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids, one a list, and the centroids of each part of the residuals."""

    coarse: Coarse
    books: tuple[np.ndarray, ...]
    cuts: tuple[int, ...]
    probes: int

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.coarse.centres[lists]
        return np.stack([nearest(rest[:, s:e], b)[0] for b, s, e in zip(self.books, self.cuts, self.cuts[1:], strict=False)], 1).astype(np.uint8)

    def slack(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The distance of every row to what its code stands for."""
        shown = self.coarse.centres[lists].astype(np.float64)
        for i, (b, s, e) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            shown[:, s:e] += b[codes[:, i]]
        return distances(x, shown)

    def table(self, q: np.ndarray, own: int) -> np.ndarray:
        """(parts, 256) squared distances of a query's residual to every sub-centroid."""
        rest, out = q - self.coarse.centres[own], np.zeros((len(self.books), 256))
        for i, (b, s, e) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            out[i, : len(b)] = ((b - rest[s:e]) ** 2).sum(1)
        return out


def valid(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, vec) of the rows that take part; vectors stay in single precision if they are, else they become double."""
    kind = "array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>"
    own = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast(kind).alias("vec")).where(F.col("id").isNotNull() & valid(F.col("vec")))
    common = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("vec") == (common["n"] if common else -1))


def probes_for(x: np.ndarray, coarse: np.ndarray, lists: np.ndarray, k: int = 10) -> int:
    """The fewest nearest lists that hold the share HELD of the sample's own exact neighbours."""
    ranks = []
    for i in np.random.default_rng(3).permutation(len(x))[:TRIALS]:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        place = np.empty(len(coarse), int)
        place[squared(x[i : i + 1], coarse)[0].argsort(kind="stable")] = np.arange(len(coarse))
        ranks.append(place[lists[near]])
    return int(np.quantile(np.concatenate(ranks), HELD)) + 1 if len(x) > 1 else 1


def drawn(own: DataFrame, wanted: int, count: int) -> DataFrame:
    """About so many of ``count`` rows, by a hash of the id."""
    return own.where(F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 30)) < min(1.0, wanted / max(1, count)) * (1 << 30))


def two_levels(rows: DataFrame, wanted: int, x: np.ndarray, lists: int) -> Coarse:
    """Cells from ``x``, and each cell's lists from its share of about ``wanted`` rows, one for every SAMPLE of them."""
    cells = kmeans(x, math.isqrt(lists))
    held = np.bincount(nearest(x, cells)[0], minlength=len(cells)) / len(x)
    pieces = np.maximum(1, np.ceil(held * wanted / PIECE)).astype(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((cells, pieces))  # at most the square root of the number of lists

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above, cut = shared.value
        for batch in batches:
            if len(batch):
                v = rough(batch["vec"].tolist())
                cell = nearest(v, above)[0]
                yield pd.DataFrame({"cell": cell, "piece": batch["_salt"].to_numpy() % cut[cell], "vec": list(v)})

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = rough(part["vec"].tolist())
        v = v[np.lexsort(v.T[::-1])]  # the same centroids whatever the order of arrival
        made = kmeans(v, max(1, round(len(v) / SAMPLE)))
        return pd.DataFrame({"cell": key[0], "piece": key[1], "place": np.arange(len(made)), "centre": list(made)})

    salted = rows.select("vec", F.pmod(F.xxhash64(F.lit("piece"), "id"), F.lit(1 << 30)).alias("_salt"))
    placed = salted.mapInPandas(place, "cell long, piece long, vec array<float>")
    found = placed.groupBy("cell", "piece").applyInPandas(fit, "cell long, piece long, place long, centre array<float>").orderBy("cell", "piece", "place").toPandas()
    own = [np.array(found.loc[found["cell"] == c, "centre"].tolist(), np.float32).reshape(-1, x.shape[1]) for c in range(len(cells))]
    own = [o if len(o) else cells[c : c + 1] for c, o in enumerate(own)]
    return Coarse(np.concatenate(own), cells, np.cumsum([0, *map(len, own)]))


def train(own: DataFrame, count: int, lists: int | None = None, parts: int = PARTS, sample: int = TRAIN) -> Quantiser:
    lists = lists or max(1, math.isqrt(count))
    wanted = max(sample, SAMPLE * lists)
    x = rough(drawn(own, min(MOST, wanted), count).orderBy("id", "vec").toPandas()["vec"].tolist())
    if not len(x):
        x = rough(own.limit(1).toPandas()["vec"].tolist())
    dim = x.shape[1]
    if SAMPLE * lists > MOST:
        coarse = two_levels(drawn(own, wanted, count), wanted, x, lists)
    else:
        coarse = Coarse(kmeans(x, max(1, min(lists, len(x) // SAMPLE)) if count > len(x) else lists))
    placed = coarse.lists(x)
    rest = x - coarse.centres[placed]
    parts = min(parts, dim)
    cuts = tuple(int(c) for c in np.linspace(0, dim, parts + 1))
    return Quantiser(coarse, tuple(kmeans(rest[:, s:e], 256, seed=i) for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))), cuts, probes_for(x, coarse.centres, placed))


def build(own: DataFrame, model: Quantiser) -> DataFrame:
    """The index: (list, id, vec, code, slack) of every vector, in the shared folder."""
    shared = own.sparkSession.sparkContext.broadcast(model)  # as many centroids as the square root of the number of vectors

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            if len(batch):
                x = rough(batch["vec"].tolist())
                lists = m.coarse.lists(x)
                codes = m.encode(x, lists)
                yield batch.assign(list=lists, code=[c.tobytes() for c in codes], slack=m.slack(np.array(batch["vec"].tolist()), lists, codes))

    made = own.mapInPandas(assign, f"id long, vec {dict(own.dtypes)['vec']}, list int, code binary, slack double")
    return materialise(made, "ivf-index")


def tuned(index: DataFrame, model: Quantiser, queries: DataFrame, k: int = 10) -> Quantiser:
    """The model with as few probes as hold the share HELD of the exact neighbours, over all of the index, of TRIALS queries."""
    trials = queries.groupBy("id").agg(F.min("vec").alias("vec")).orderBy(F.xxhash64("id")).limit(TRIALS).toPandas()
    if not len(trials):
        return model
    asked = rough(trials["vec"].tolist())
    shared = index.sparkSession.sparkContext.broadcast((trials["id"].to_numpy(), asked.astype(np.float64)))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        d, lists = np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            if len(batch):
                new = squared(q, rough(batch["vec"].tolist()).astype(np.float64))
                new[ids[:, None] == batch["id"].to_numpy()[None]] = np.inf
                d, lists = np.hstack([d, new]), np.hstack([lists, np.broadcast_to(batch["list"].to_numpy(), new.shape)])
                kept = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                d, lists = np.take_along_axis(d, kept, 1), np.take_along_axis(lists, kept, 1)
        at, _ = held = np.nonzero(np.isfinite(d))
        yield pd.DataFrame({"trial": at, "list": lists[held], "d": d[held]})

    found = index.select("id", "vec", "list").mapInPandas(near, "trial int, list int, d double")
    nearest_of = Window.partitionBy("trial").orderBy("d", "list")
    met = found.withColumn("_n", F.row_number().over(nearest_of)).where(F.col("_n") <= k).select("trial", "list").toPandas()
    if not len(met):
        return model
    # The place of each neighbour's list among the lists in order of their distance to the query.
    place = squared(asked, model.coarse.centres).argsort(1, kind="stable").argsort(1, kind="stable")
    ranks = place[met["trial"].to_numpy(), met["list"].to_numpy()]
    return replace(model, probes=int(np.quantile(ranks, HELD, method="higher")) + 1)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, slack: np.ndarray, own: int, model: Quantiser, k: int, rerank: int) -> pd.DataFrame:
    """Each query's k nearest of one list part: scan by table, then exact distances of the best and of all that could be nearer."""
    out, rows = [], np.arange(codes.shape[1])
    for qid, q in zip(query_ids, queries, strict=True):
        with np.errstate(over="ignore"):
            near, most = model.table(q.astype(np.float64), own)[rows, codes].sum(1), np.linalg.norm(q.astype(np.float64))
        mine = np.arange(len(ids))
        own_rows = np.flatnonzero(ids == qid)
        own_rows = own_rows[(vectors[own_rows] == q).all(1)][:1]  # rows alike in id and vector lie in one part
        mine = np.delete(mine, own_rows)
        if len(mine) > rerank:
            # All rows as near as the last one that fits stay, so equal codes are never cut by chance.
            last = np.partition(near[mine], rerank - 1)[rerank - 1]
            # A row lies within its slack of what its code stands for: one whose least distance is
            # beyond k others' greatest is not among the k nearest. NaN, of overflows, stays.
            shown = np.sqrt(near[mine])
            kth = min(k, len(mine)) - 1
            far = np.partition(shown + slack[mine], kth)[kth] * (1 + 1e-6) + 1e-12 * most
            with np.errstate(invalid="ignore"):
                mine = mine[(near[mine] <= last) | ~(shown - slack[mine] > far)]
        d = distances(q, vectors[mine])
        order = np.lexsort([ids[mine], d])[:k]
        out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[mine][order], "score": d[order]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(index: DataFrame, model: Quantiser, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score); ``queries``: (id, vec)."""
    spark, probes = index.sparkSession, probes or model.probes
    # A table of one row a list; Spark broadcasts it while it is small, by its size on disk.
    lists = materialise(index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "ivf-lists")
    sizes = np.zeros(len(model.coarse.centres), np.int64)
    for r in lists.select("list", "n").toLocalIterator():
        sizes[r["list"]] = r["n"]
    shared = spark.sparkContext.broadcast((model, sizes))
    cut = index.join(lists, "list").withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int")).drop("n", "parts")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, n = shared.value
        for batch in batches:
            if not len(batch):
                continue
            order = squared(rough(batch["vec"].tolist()), m.coarse.centres).argsort(1, kind="stable")
            held = n[order].cumsum(1)
            # At least ``probes`` lists, and as many as hold k rows besides the query's own.
            take = np.maximum(probes, (held < 2 * k + 1).sum(1) + 1)
            rows = [(i, v, c) for i, v, o, t in zip(batch["id"], batch["vec"], order, take, strict=True) for c in o[:t] if n[c]]
            yield pd.DataFrame(rows, columns=["query_id", "query", "list"])

    one = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    sent = one.mapInPandas(route, f"query_id long, query {dict(queries.dtypes)['vec']}, list int")
    sent = sent.join(lists, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("n", "parts")

    def scan(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        m, _ = shared.value
        if not len(asked) or not len(held):
            return best(np.zeros(0), np.zeros((0, 1)), np.zeros(0), np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0), 0, m, k, rerank)
        codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
        return best(asked["query_id"].to_numpy(), np.array(asked["query"].tolist()), held["id"].to_numpy(), np.array(held["vec"].tolist()), codes, held["slack"].to_numpy(), int(held["list"].iloc[0]), m, k, rerank)

    found = sent.groupBy("list", "part").cogroup(cut.groupBy("list", "part")).applyInPandas(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = usable(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    count = own.count()
    if not count:
        return own.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    model, queries = train(own, count), own.where("id % 100 = 0")
    index = build(own, model)
    return search(index, tuned(index, model, queries), queries)


QUERIES = {"op6_nearest": op6_nearest}
ORACLES: dict[str, str] = {}
