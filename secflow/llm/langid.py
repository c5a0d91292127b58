"""Language identification by n-gram filters that answer for all languages at once.

Training counts, in how many of a language's documents each character n-gram (3 to 5
letters, with a blank at word borders) occurs. An n-gram is typical of every language in
which its rate is at least ``ratio`` of its highest rate over languages, and in at least
``min_docs`` documents and ``LEAST_RATE`` of them. The typical n-grams go into a bit-sliced Bloom filter: each of its
``slots`` holds a mask with one bit per language (of as many words as the languages need), so
that the AND of an n-gram's slots is the mask of all languages that may contain it. For a text, the bits of all n-grams' masks
are counted per language. Each count is corrected for the language's false-positive rate
(its share of filled slots to the power of the number of hashes), and the largest
corrected count decides.

Only the filter (a fixed number of slots) goes through the driver. It is trained on all
labelled documents; ``LEAST_RATE`` keeps its n-grams from growing with their number.

A text may be in no learned language at all, and the largest count still names one. For a
filter that drops such texts, ``least_shares`` learns what share of their n-grams the
documents of each language have at least, and ``recognised`` compares a text's with it.

Rows: a null text or one without letters is ``und`` with score 0. Null languages teach
nothing; without any training rows every text is ``und``. Equal counts fall to the first
language in code-point order. Repeated rows keep one output row each; other columns pass
through, same-named ones are replaced; an empty table gives an empty table. Texts are read
whole, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.llm.common import crc32_of_id, read

UNKNOWN = "und"
SIZES = (3, 4, 5)
HASHES = 3
#: Filter slots (the driver holds one mask each); the rate in a language that an n-gram needs (more than two documents from 5,000 of the language on).
SLOTS, LEAST_RATE = 1 << 20, 1 / 2_500
#: n-grams of documents that are counted at a time.
COUNTED = 1 << 21
#: Languages of one word of a mask.
WORD = 63
#: Letters of a text that are looked up at a time.
PIECE = 1 << 20
#: A learned share is this part of the share that all but LOW of the language's documents have; below it by ERRORS standard errors, a text is in another language.
LOW, PART, ERRORS = 0.01, 0.5, 3.0
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point to its lower-case letter, 0 for anything but a letter."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _FOLD.append(table)
    return _FOLD[0]


def letters(text: str) -> np.ndarray:
    """Folded letters of a text with single 0s for what lies between words and at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    folded = np.zeros(len(points) + 2, np.uint32)
    folded[1:-1] = fold_table()[np.minimum(points, 0x10FFFF)]
    keep = (folded > 0) | np.concatenate([[True], folded[:-1] > 0])
    return folded[keep]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_hashes(folded: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams that have no blank inside."""
    wide = folded.astype(np.uint64)
    found = []
    for n in SIZES:
        count = len(wide) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint64)
        whole = np.ones(count, bool)
        for i in range(n):
            part = wide[i : i + count]
            h = h * np.uint64(0x100000001B3) + part
            if 0 < i < n - 1:
                whole &= part > 0
        found.append(_mix(h[whole]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def slots_of(h: np.ndarray, slots: int) -> list[np.ndarray]:
    """The HASHES slots of each hash."""
    step = (h >> np.uint64(33)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(slots)).astype(np.int64) for i in range(HASHES)]


def pieces(text: str) -> Iterator[np.ndarray]:
    """n-gram hashes of a whole text, in pieces; n-grams across a border belong to the earlier piece."""
    folded, over = letters(text), max(SIZES) - 1
    for at in range(0, len(folded), PIECE):
        part = folded[at : at + PIECE + over]
        h = gram_hashes(part)
        if at + PIECE + over < len(folded) or at + PIECE < len(folded):
            tail = gram_hashes(folded[at + PIECE : at + PIECE + over])  # counted again by the next piece
            if len(tail):
                values, n = np.unique(tail, return_counts=True)
                order = np.argsort(h, kind="stable")
                start = np.searchsorted(h[order], values)
                drop = np.concatenate([order[s : s + k] for s, k in zip(start, n, strict=True)])
                h = np.delete(h, drop)
        yield h


class Filter:
    """A trained bit-sliced filter: a mask of one or more words per slot; ``masks`` and ``rates`` are all that a prediction needs."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        # The narrowest type: the filter should stay in the processor's cache.
        self.languages, masks = languages, masks.reshape(len(masks), -1)
        self.masks = masks.astype(np.min_scalar_type((1 << max(1, min(WORD, len(languages)))) - 1))
        fill = self.holders(self.masks) / len(masks)
        self.rates = fill**HASHES

    def holders(self, masks: np.ndarray) -> np.ndarray:
        """How many of the masks have each language's bit."""
        kind = self.masks.dtype.type
        return np.array([np.count_nonzero(masks[:, i // WORD] & kind(1 << i % WORD)) for i in range(len(self.languages))])

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Mask of the languages that may contain each n-gram."""
        at = slots_of(h, len(self.masks))
        found = self.masks[at[0]]
        for s in at[1:]:
            found = found & self.masks[s]
        return found

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected number of the text's n-grams per language, and the number of all n-grams."""
        total, n = np.zeros(len(self.languages)), 0
        for h in pieces(text):
            n += len(h)
            total += self.holders(self.lookup(h))
        return np.maximum(0, (total - n * self.rates) / np.maximum(1 - self.rates, 1e-9)), n

    def predict(self, text: str | None) -> tuple[str, float, float, int]:
        """The language, its share of the two largest corrected counts (0 to 1), its corrected count and the number of n-grams."""
        if not text or not self.languages or not letters(text).any():
            return UNKNOWN, 0.0, 0.0, 0
        c, n = self.counts(text)
        best = int(np.argmax(c))
        others = np.delete(c, best)
        second = float(others.max()) if len(others) else 0.0
        return self.languages[best], float(c[best] / (c[best] + second)) if c[best] > 0 else 0.0, float(c[best]), n


def labelled(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The (text, lang) of documents that teach."""
    return docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", slots: int = SLOTS, ratio: float = 0.4, min_docs: int = 2, least_rate: float = LEAST_RATE) -> Filter:
    """Learns a filter from all labelled documents."""
    known = labelled(docs, text, lang)
    languages = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").collect()]  # one row a language
    if not languages:
        return Filter([], np.zeros(slots, np.uint64))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                held, size = [], 0
                for i, t in enumerate(part["text"], 1):
                    held.append(np.unique(np.concatenate(list(pieces(t)) or [np.zeros(0, np.uint64)])))
                    size += len(held[-1])
                    if size >= COUNTED or i == len(part):
                        h, n = np.unique(np.concatenate(held), return_counts=True)
                        yield pd.DataFrame({"lang": name, "h": h.view(np.int64), "n": n.astype(np.int64), "docs": 0})
                        held, size = [], 0
                yield pd.DataFrame({"lang": [name], "h": [None], "n": [None], "docs": [len(part)]}).astype({"h": "Int64", "n": "Int64"})

    counted = known.mapInPandas(grams, "lang string, h long, n long, docs long")
    by_gram = counted.groupBy("h", "lang").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_gram = by_gram.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct("n", "docs").alias("v")))).alias("v")).persist()
    docs_of = {k: v["docs"] for k, v in (by_gram.where(F.col("h").isNull()).first() or {"v": {}})["v"].items()}
    least = {x: max(min_docs, least_rate * docs_of.get(x, 0)) for x in languages}
    rate = F.array(*(F.when(F.coalesce(F.col("v")[x]["n"], F.lit(0)) >= least[x], F.col("v")[x]["n"] / F.lit(max(1, docs_of.get(x, 0)))).otherwise(0.0) for x in languages))
    typical = by_gram.where(F.col("h").isNotNull()).select("h", rate.alias("r")).withColumn("top", F.array_max("r")).where(F.col("top") > 0)
    words = [F.lit(0).cast("long") for _ in range(0, len(languages), WORD)]
    for i in range(len(languages)):
        words[i // WORD] = words[i // WORD].bitwiseOR(F.when(F.col("r")[i] >= ratio * F.col("top"), F.lit(1 << i % WORD)).otherwise(F.lit(0)).cast("long"))
    names = [f"m{w}" for w in range(len(words))]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in slots_of(batch["h"].to_numpy(np.int64).view(np.uint64), slots):
                yield batch[names].assign(slot=s)

    made = typical.select("h", *(w.alias(n) for w, n in zip(words, names, strict=True))).mapInPandas(fill, ", ".join(f"{n} long" for n in [*names, "slot"]))
    filled = made.groupBy("slot").agg(*(F.bit_or(n).alias(n) for n in names)).toPandas()
    by_gram.unpersist()
    masks = np.zeros((slots, len(names)), np.uint64)
    masks[filled["slot"].to_numpy(np.int64)] = filled[names].to_numpy(np.int64).view(np.uint64)
    return Filter(languages, masks)


def identify(docs: DataFrame, model: Filter, text: str = "text", evidence: bool = False) -> DataFrame:
    """Adds ``lang_pred`` and ``score``; as ``evidence`` also ``lang_count`` (corrected) and ``n_grams``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks))  # a fixed number of slots
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_count", T.DoubleType()), T.StructField("n_grams", T.LongType())][: 4 if evidence else 2])
    kept = [c for c in docs.columns if c not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(*shared.value)
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            types = (pa.string(), pa.float64(), pa.float64(), pa.int64())[: len(added)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([f[i] for f in found], t) for i, t in enumerate(types))], [*kept, *added.names])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *added.fields]))


def least_shares(docs: DataFrame, model: Filter, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """For each language, the share of n-grams that its labelled documents have at least, with a margin."""
    found = identify(labelled(docs, text, lang), model, evidence=True).where("lang = lang_pred AND n_grams > 0")
    low = found.groupBy("lang").agg(F.percentile_approx(F.col("lang_count") / F.col("n_grams"), LOW).alias("low")).collect()  # one row a language
    return {r["lang"]: PART * min(1.0, r["low"]) for r in low}


def recognised(least: dict[str, float]) -> Column:
    """Whether an identified text, with its evidence, has enough n-grams of the language found; short texts get the benefit of the doubt, those without any n-gram of it don't."""
    if not least:
        return F.lit(False)
    share = F.coalesce(F.create_map(*(F.lit(x) for item in least.items() for x in item))[F.col("lang_pred")], F.lit(0.0))
    n = F.col("n_grams")
    return (F.col("lang_count") > 0) & (F.col("lang_count") >= share * n - ERRORS * F.sqrt(n * share * (1 - share)))


def held_out() -> Column:
    return F.pmod(crc32_of_id(), F.lit(3)) == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
