"""Corpus pipeline over ``documents``: language ID, line dedup, near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
a DataFrame; it is written as Parquet and reread as the next stage's input. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.llm import bpe, langid, line_dedup, minhash, mixing
from secflow.llm.common import discard, materialise, read

#: Whole-pipeline SQL would have to express the language filter, the forest and BPE; it can't.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in no learned language go; ``lang`` becomes the language found."""
    labelled = docs.where(~langid.held_out()).select("text", "lang")
    model = langid.train(labelled)
    least = langid.least_shares(labelled, model)
    found = langid.identify(docs.select(*COLUMNS), model, evidence=True)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & langid.recognised(least)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays."""
    kept = line_dedup.drop_frequent_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.keep_one_of_each(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the mixed order."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    made = bpe.round_trip(docs.select(*COLUMNS), bpe.default_vocabulary(), with_ids=True)
    return made.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("mixing", source_mixing),
    ("bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(spark, last)
        last = docs
    return docs
