"""The pipeline's language filter: other languages go, those learned stay."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from secflow.llm import langid

SF = "/root/testdata/sf0.01"
OTHERS = [
    "De snelle bruine vos springt over de luie hond en rent door het bos naar huis, waar zijn kinderen al uren wachten.",
    "Съешь ещё этих мягких французских булок да выпей чаю",
    "快速的棕色狐狸跳过了懒狗",
    "Il gatto nero dorme sempre sul divano della nonna durante il pomeriggio",
]


def test_only_learned_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    other = spark.createDataFrame([(1_000_000 + i, t, None, "x", len(t)) for i, t in enumerate(OTHERS)], docs.schema)
    got = corpus_pipeline.language_id(spark, docs.union(other), SF)
    assert got.where("doc_id >= 1000000").count() == 0
    assert got.count() == docs.count()


def test_a_language_that_was_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    hidden = docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, hidden, SF).select("doc_id").collect()}
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert {i for i, l in langs.items() if l != "es"} <= kept
    # One of the 106 is half a license in English.
    assert sum(langs[i] == "es" for i in kept) <= 1


def test_no_labels_leave_nothing(spark):
    docs = spark.createDataFrame([(1, "the cat", None, "x", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language_id(spark, docs, SF).count() == 0


def test_every_labelled_document_teaches(spark):
    """30,000 documents of a language, copies of 12 texts: an earlier sample of 20,000, drawn by the text, left some texts out whole."""
    texts = [f"{c}{c}q{c}{c} q{c}{c}q" for c in "abcdefghijkl"]
    docs = spark.range(30_000).select(F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 12 + 1).cast("int")).alias("text"), F.lit("aa").alias("lang"))
    model = langid.train(docs, slots=1 << 16)
    for t in texts:
        counts, n = model.counts(t)
        assert counts[0] == pytest.approx(n)
    assert langid.least_shares(docs, model) == {"aa": langid.PART}
