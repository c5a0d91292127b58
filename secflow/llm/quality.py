"""Document quality by Bradley-Terry pairwise ranking.

Every document has features of its text alone: lengths, shares of letter cases, digits and
symbols, repetition of words, lines and word pairs, and compressibility. From labelled
documents, preference pairs (a good one over a bad one) are formed; the model is a linear
score whose differences explain the preferences: logistic loss on feature differences with
a ridge penalty, solved by Newton steps. The threshold is the quantile of the training
scores at which as many documents fall below as are labelled bad; scores are mapped to
0..1 so that this quantile lies at ``cut``.

Training uses every labelled document. Their feature rows fall, by a hash, into blocks of
about ``BLOCK`` rows; pairs are formed inside a block, ``PAIRS_EACH`` for each row of its
larger class. Rows of a class too rare to reach every block are in several. Centre, scale
and each Newton step are sums over all rows or blocks, of which the driver sees one row of
sums a task; the threshold is read from all training scores. Scoring covers all documents on
the executors.

Rows: null and empty texts have all features 0 and get a score like any other; null labels
teach nothing; with one class only, or no labels, every score is ``cut``. Repeated rows and
ties keep one output row each; a label whose id occurs on several rows teaches each of
them. Other columns pass through, same-named ones are replaced; an empty table gives an
empty table. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.llm.common import crc32_of_id, discard, materialise, read

#: Preference pairs for each row of the larger class; rows of a block of pairs, and rows of either class that it has about, at least.
PAIRS_EACH, BLOCK, LEAST = 20, 8192, 64
#: The threshold is the wanted quantile of the training scores, but for one row in so many.
ACCURACY = 1_000_000
STEPS = 25
SYMBOLS = "!|$%#&*@<>{}[]()/\\_=+~^;:\"'?-"
RIDGE = 1e-3


def _classes() -> np.ndarray:
    """ASCII to a class: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 full stop or comma, then one per symbol; 255 not ASCII."""
    table = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 6 if c in ".," else 7 + SYMBOLS.index(c) if c in SYMBOLS else 0
    table[128:] = 7 + len(SYMBOLS)
    return table


CLASSES = _classes()
N_CLASSES = 8 + len(SYMBOLS)


def features(text: str | None) -> np.ndarray:
    """The feature row of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(N_FEATURES, np.float64)
    kinds = CLASSES[np.frombuffer(raw, np.uint8)]
    shares = np.bincount(kinds, minlength=N_CLASSES) / len(raw)
    words = text.lower().split()
    n = max(1, len(words))
    counts = Counter(words)
    tops = sum(c for _, c in counts.most_common(3)) / n
    pairs = Counter(zip(words, words[1:], strict=False))
    repeated = sum(c - 1 for c in pairs.values()) / n
    same_as_last = sum(c for (a, b), c in pairs.items() if a == b) / n
    size = sum(map(len, words)) / n
    lines = text.split("\n")
    line_copies = 1 - len(set(lines)) / len(lines)
    packed = len(zlib.compress(raw, 1)) / len(raw)
    shouting = np.count_nonzero((kinds[1:] == 2) & (kinds[:-1] == 2)) / len(raw)
    symbol_runs = np.count_nonzero((kinds[1:] == kinds[:-1]) & (kinds[1:] >= 7) & (kinds[1:] < N_CLASSES - 1)) / len(raw)
    unique = len(counts) / n
    extra = [np.log1p(n), unique, unique * np.log1p(n), tops, repeated, same_as_last, size, np.log1p(size), abs(size - 5), len(lines) / n, line_copies, packed, packed * np.log1p(n), min(1.0, packed), shouting, symbol_runs, float(n < 5), float(n < 20)]
    return np.concatenate([np.sqrt(shares), extra])


N_FEATURES = N_CLASSES + 18


@dataclass(frozen=True)
class Ranking:
    """A fitted score: weights on standardised features, then a line through the quantile."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        return standardised(rows, self.centre, self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; ``cut`` at the threshold."""
        z = self.slope * (self.latent(rows) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def standardised(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((rows - centre) / scale, -8, 8)


def differences(good: np.ndarray, bad: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` pairs, good row less bad row, every row used about equally often."""
    rng = np.random.default_rng(seed)

    def spread(size: int) -> np.ndarray:
        return np.concatenate([rng.permutation(size) for _ in range(-(-n // size))])[:n]

    return good[spread(len(good))] - bad[spread(len(bad))]


def step_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What pairs add to a Newton step: their number, the gradient and the curvature, one behind another."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the bad one wins
    return np.concatenate([[len(d)], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def solve(sums: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Bradley-Terry weights: Newton steps on the sums that all pairs give at some weights."""
    w = np.zeros(width)
    for _ in range(STEPS):
        n, gradient, curve = np.split(sums(w), [1, 1 + width])
        step = np.linalg.solve(curve.reshape(width, width) / n + RIDGE * np.eye(width), gradient / n - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def usable(scale: np.ndarray) -> np.ndarray:
    """Standard deviations to divide by."""
    return np.where(scale + 1e-9 < 1e-6, 1.0, scale + 1e-9)


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int, cut: float, seed: int = 7) -> Ranking:
    """The ranking of a single block of rows, all in memory, from at most ``pairs`` pairs."""
    rows = np.concatenate([good, bad])
    centre, scale = rows.mean(0), usable(rows.std(0))
    d = differences(standardised(good, centre, scale), standardised(bad, centre, scale), min(pairs, PAIRS_EACH * max(len(good), len(bad))), seed)
    w = solve(lambda w: step_sums(d, w), rows.shape[1])
    return Ranking(centre, scale, w, float(np.quantile(standardised(rows, centre, scale) @ w, len(bad) / len(rows))), 1.0, cut)


def unpacked(packed: pd.Series) -> np.ndarray:
    """Rows of features from their bytes."""
    return np.frombuffer(b"".join(packed), np.float64).reshape(-1, N_FEATURES)


def _with_features(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keep].assign(features=[features(t).tobytes() for t in batch[text]])

    return docs.mapInPandas(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("features", T.BinaryType())]))


def _summed(rows: DataFrame, of: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of what ``of`` makes of the table's batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(of(batch) for batch in batches if len(batch))
        if isinstance(total, np.ndarray):
            yield pd.DataFrame({"sums": [total.tolist()]})

    return np.sum([r["sums"] for r in rows.mapInPandas(run, "sums array<double>").collect()], 0)  # one row a task


def _blocks(rows: DataFrame, sizes: dict[int, int], block: int) -> DataFrame:
    """Feature rows in blocks that hold both classes: one row (good, bad) of packed features a block."""
    n = max(1, -(-sum(sizes.values()) // block))
    # A class of too few rows for all blocks has each of them in several.
    copies = F.when(F.col("_label") == 1, min(n, -(-LEAST * n // sizes[1]))).otherwise(min(n, -(-LEAST * n // sizes[0])))
    spread = rows.withColumn("_block", F.explode(F.transform(F.sequence(F.lit(1), copies), lambda i: (F.pmod("_at", F.lit(n)) + i) % n)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        x, y = unpacked(part["features"]), part["_label"].to_numpy()
        order = np.lexsort([*x.T[::-1], y])  # the same rows in any order learn the same model
        x, y = x[order], y[order]
        return pd.DataFrame({"_block": [part["_block"].iloc[0]], "good": [x[y == 1].tobytes()], "bad": [x[y == 0].tobytes()]})

    return spread.select("_block", "_label", "features").groupBy("_block").applyInPandas(pack, "_block long, good binary, bad binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", cut: float = 0.3, block: int = BLOCK) -> Ranking | None:
    """Learns from all labelled documents; None without both classes."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label"))
    # A merge join at any size: a broadcast of labels would only do for small tables.
    taught = docs.select("doc_id", text, F.xxhash64(F.lit("pairs"), "doc_id", text).alias("_at")).join(known.hint("merge"), "doc_id")
    rows = materialise(_with_features(taught, text, ["_label", "_at"]), "features")
    sizes = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}  # one row a class
    if len(sizes) < 2:
        discard(docs.sparkSession, rows)
        return None
    n = sum(sizes.values())
    centre = _summed(rows, lambda b: unpacked(b["features"]).sum(0)) / n
    scale = usable(np.sqrt(_summed(rows, lambda b: np.square(unpacked(b["features"]) - centre).sum(0)) / n))
    blocks = materialise(_blocks(rows, sizes, block), "blocks")

    def sums(w: np.ndarray) -> np.ndarray:
        def of(batch: pd.DataFrame) -> np.ndarray:
            total = np.zeros(1 + len(w) + len(w) ** 2)
            for seed, good, bad in zip(batch["_block"], batch["good"], batch["bad"], strict=True):
                g, b = (standardised(unpacked([x]), centre, scale) for x in (good, bad))
                if len(g) and len(b):
                    total += step_sums(differences(g, b, PAIRS_EACH * max(len(g), len(b)), 7 + int(seed)), w)
            return total

        return _summed(blocks, of)

    w = solve(sums, N_FEATURES)

    def latent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"latent": standardised(unpacked(batch["features"]), centre, scale) @ w})

    # As many training scores as there are bad rows lie below: between two neighbours in their order.
    place = sizes[0] / n * (n - 1)
    below = int(place)
    at = [(min(i, n - 1) + 0.5) / n for i in (below, below + 1)]
    low, high = rows.mapInPandas(latent, "latent double").agg(F.percentile_approx("latent", at, ACCURACY)).first()[0]
    discard(docs.sparkSession, rows, blocks)
    return Ranking(centre, scale, w, low + (high - low) * (place - below), 1.0, cut)


def rank(docs: DataFrame, model: Ranking | None, text: str = "text", cut: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if score >= ``cut``)."""
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    kept = [c for c in docs.columns if c not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            rows = np.array([features(t.as_py()) for t in texts]).reshape(batch.num_rows, N_FEATURES)
            score = np.full(batch.num_rows, cut) if model is None else model.score(rows)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32), pa.int32())], [*kept, *added.names])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *added.fields]))


def held_out() -> Column:
    return F.pmod(crc32_of_id(), F.lit(5)) == 0


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels").where(~held_out()))
    return rank(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
