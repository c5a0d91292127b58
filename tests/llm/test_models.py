"""Language ID, quality, nearest neighbours, mixing, token shards: held-out accuracy, recall, exactness, odd rows."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from secflow.llm import bpe, ivfpq, langid, mixing, quality, token_shards

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = langid.op1_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the dog sees the cat", "en"), (4, "le chien voit le chat", "fr")] * 3, "doc_id long, text string, lang string")
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "le chat " * 200_000, "x"), (4, "the cat", "x"), (4, "the cat", None)], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (4, "en"), (4, "en")]
    assert langid.identify(odd.limit(0), model).count() == 0
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_pieces_count_every_gram_once():
    text = "ab cde fghij " * 30
    whole = np.sort(langid.gram_hashes(langid.letters(text)))
    old, langid.PIECE = langid.PIECE, 7
    try:
        parts = np.sort(np.concatenate(list(langid.pieces(text))))
    finally:
        langid.PIECE = old
    assert np.array_equal(whole, parts)


def test_quality_held_out(spark):
    got = quality.op7_quality(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.9
    assert got["score"].between(0, 1).all()


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "x " * 100_000, 0.5), (None, "text", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.train(docs, labels) is None
    assert {(r.score, r.predicted) for r in quality.rank(docs, None).collect()} == {(0.3, 1)}
    assert quality.rank(docs.limit(0), None).count() == 0


def test_nearest_recall(spark):
    got = ivfpq.op6_nearest(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), np.float64)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        other = ids != q
        order = np.lexsort([ids[other], d[other]])[:10]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        place = {v: s for v, s in zip(ids, d, strict=True)}
        assert np.allclose(own["score"], [place[v] for v in own["vec_id"]], rtol=1e-12)
        hits += len(set(own["vec_id"]) & set(ids[other][order]))
        total += 10
    assert hits / total >= 0.9


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [0.0, 2.0]), (None, [1.0, 1.0])]
    own = ivfpq.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert sorted(r.id for r in own.collect()) == [0, 7, 100]
    model = ivfpq.train(own, 3)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ivfpq.search(ivfpq.build(own, model), model, own.where("id % 100 = 0")).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 7, 2.236068), (100, 1, 0, 0.0), (100, 2, 7, 2.236068)]


def mix_rows(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(300)] + [(1000, "big " * 40, None), (1001, None, "s0"), (1002, "", "s9"), (None, "a b", "s1"), (7, "x y", "s1"), (7, "x y", "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix(spark):
    docs = mix_rows(spark)
    got = mixing.Mix(docs).taken().collect()
    total = sum(r["size"] for r in got)
    assert len(got) == docs.count() and sum(r.taken for r in got) == int(total * 1.5)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r["size"] for r in own) + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.Mix(docs.repartition(7)).taken().collect()))
    order = mixing.Mix(docs).order().collect()
    assert sum(r.taken for r in order) == sum(r.taken for r in got)
    # The documents come in the mixed order.
    mixed = mixing.mix_documents(docs.withColumns({"_document": F.lit(1), "copy": F.lit("own"), "size": F.lit(None)}))
    assert mixed.columns == [*docs.columns, "_document", "copy", "size"]
    place = {}
    for r in order:
        place.setdefault((r.doc_id, r.source, r["size"]), []).append(r.at)
    got = [(r.doc_id, r.source, len(r.text.split())) for r in mixed.collect()]
    assert len(got) == len(order) and len(order) > docs.count() / 2
    assert [min(place[k]) for k in dict.fromkeys(got)] == sorted(min(place[k]) for k in dict.fromkeys(got))
    times = mixing.mix_documents(docs).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in times) <= 4
    assert mixing.Mix(docs.limit(0)).taken().count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 1000, 4097):
        for key in (1, 99):
            assert sorted(token_shards.permute(np.arange(n), n, key)) == list(range(n))
    assert list(token_shards.permute(np.arange(1000), 1000, 1)) != list(token_shards.permute(np.arange(1000), 1000, 2))


def test_shards(spark):
    vocabulary = bpe.default_vocabulary()
    rows = [(i, f"some text number {i} " * (i % 9)) for i in range(40)] + [(50, None), (51, ""), (None, "no id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = token_shards.materialise_order(docs, vocabulary, length=16, per_shard=8)
    got = token_shards.read_from(made, length=16).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all(r.shard == r.slot // 8 and r.byte_offset == r.slot % 8 * (16 + 32) for r in got)
    codec, want = bpe.codec(vocabulary), []
    for i, t in rows:
        ids = [*codec.encode(t or "").tolist(), 50256]
        want += [(str(i), n // 16, ids[n : n + 16]) for n in range(0, len(ids), 16)]
    assert sorted((str(r.doc_id), r.part, r.token_ids) for r in got) == sorted(want)
    shards = token_shards.materialise_order(docs.repartition(5).withColumn("extra", F.lit(1)), vocabulary, length=16, per_shard=8, shards_per_task=2)
    for slot in (11, 16, 40, len(got) - 1, len(got) + 5):
        later = token_shards.read_from(shards, slot=slot, length=16)
        assert sorted(map(str, later.collect())) == sorted(str(r) for r in got if r.slot >= slot)
    # What lies before the slot is never opened: it may be gone.
    folders = {f.split("task=")[1].split("/")[0]: f.rsplit("/", 1)[0].removeprefix("file://") for f in shards.inputFiles()}
    assert len(folders) > 3
    later = token_shards.read_from(shards, slot=40, length=16)
    for task, folder in folders.items():
        if int(task) < 40 // 16:
            shutil.rmtree(folder)
    assert sorted(map(str, later.collect())) == sorted(str(r) for r in got if r.slot >= 40)
    long = [(1, "a b " * 30_000)]
    assert token_shards.read_from(token_shards.materialise_order(spark.createDataFrame(long, "doc_id long, text string"), vocabulary)).agg(F.sum("n_tokens")).first()[0] == len(codec.encode(long[0][1])) + 1
    assert token_shards.materialise_order(docs.limit(0), vocabulary).count() == 0


def test_nearest_of_repeated_ids_ties_and_doubles(spark, tmp_path):
    rows = [(100 * (i // 3), [float(i % 3), 1.0]) for i in range(9)] + [(7, [1e300, -1e300]), (8, [1e300, 0.0]), (9, [0.1, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ivfpq.op6_nearest(spark, str(tmp_path)).collect()
    for q in (0, 100, 200):
        mine = min(v for i, v in rows if i == q)
        d = lambda v, m=mine: np.hypot(v[0] - m[0], v[1] - m[1])
        want = sorted((d(v), i) for i, v in rows if (i, v) != (q, mine))[:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == [i for _, i in want]
        assert np.allclose([r.score for r in own], [x for x, _ in want], rtol=1e-14)
    table.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert ivfpq.op6_nearest(spark, f"{tmp_path}/none").count() == 0


def test_nearest_of_rows_alike_in_id_and_vector(spark):
    """One of them is the query's own row, the others are neighbours at distance 0."""
    rows = [(100, [1.0, 2.0])] * 3 + [(5, [1.0, 3.0])]
    own = spark.createDataFrame(rows, "id long, vec array<double>")
    model = ivfpq.train(own, 4)
    got = [(r["rank"], r.vec_id, r.score) for r in ivfpq.search(ivfpq.build(own, model), model, own.where("id = 100")).orderBy("rank").collect()]
    assert got == [(1, 100, 0.0), (2, 100, 0.0), (3, 5, 1.0)]


def test_lists_on_two_levels(spark, monkeypatch):
    """More lists than the driver's sample could fit: cells, lists within them, small pieces; recall against brute force."""
    monkeypatch.setattr(ivfpq, "MOST", 400)
    monkeypatch.setattr(ivfpq, "PIECE", 300)
    rnd = np.random.default_rng(8)
    centres = rnd.normal(0, 4, (30, 12))
    x = np.concatenate([centres[0] + rnd.normal(0, 1, (1500, 12)), centres[rnd.integers(0, 30, 2500)] + rnd.normal(0, 1, (2500, 12))])
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    model = ivfpq.train(own, len(x), sample=400)
    assert model.coarse.cells is not None and len(model.coarse.centres) > 400 // ivfpq.SAMPLE
    assert model.coarse.starts[-1] == len(model.coarse.centres) and (np.diff(model.coarse.starts) > 0).all()
    index = ivfpq.build(own, model)
    assert index.count() == len(x) and index.agg(F.max("list")).first()[0] < len(model.coarse.centres)
    got = ivfpq.search(index, model, own.where("id % 100 = 0")).toPandas()
    hits = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(got.loc[got["query_id"] == q, "vec_id"]) & set(np.argsort(d)[:10].tolist()))
    assert hits / (10 * len(range(0, len(x), 100))) >= 0.9


def test_more_languages_than_bits_of_a_word(spark):
    """Every language has words of its own; masks, rates and corrected counts against sets."""
    names = [f"l{i:03}" for i in range(150)]
    word = lambda i, k: "".join(chr(0x4E00 + 40 * i + 7 * k + j) for j in range(5))
    docs = spark.createDataFrame([(" ".join(word(i, k) for k in range(4)), n) for i, n in enumerate(names) for _ in range(3)], "text string, lang string")
    model = langid.train(docs, slots=1 << 14)
    assert model.masks.shape == (1 << 14, 3)
    held = {n: set() for n in names}
    for i, n in enumerate(names):
        held[n] = set(np.concatenate(list(langid.pieces(" ".join(word(i, k) for k in range(4))))).tolist())
    for i in (0, 62, 63, 149):
        grams = np.array(sorted(held[names[i]]), np.uint64)
        masks = model.lookup(grams)
        assert all(masks[:, i // langid.WORD] & model.masks.dtype.type(1 << i % langid.WORD))
        slots = {int(s) for h in held[names[i]] for s in np.concatenate(langid.slots_of(np.array([h], np.uint64), 1 << 14))}
        assert model.rates[i] == pytest.approx((len(slots) / (1 << 14)) ** langid.HASHES)
        counts, n = model.counts(" ".join(word(i, k) for k in range(4)))
        assert n == len(grams) and counts[i] == pytest.approx(n) and counts.argmax() == i
    got = langid.identify(docs.withColumnRenamed("lang", "own"), model).where("own <> lang_pred").count()
    assert got == 0


def test_quality_learns_from_every_labelled_row(spark):
    """More rows than a block or an earlier sample of 20,000, and a class with too few for every block."""
    bad = (7, 9_000, 24_999)
    text = F.when(F.col("doc_id").isin(*bad), F.concat(F.lit("## $$ %% "), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("plain words of text "), F.col("doc_id").cast("string")))
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.select("doc_id", (~F.col("doc_id").isin(*bad)).cast("int").alias("quality"))
    model = quality.train(docs, labels, block=2_000)
    rows = np.array([quality.features(r["text"]) for r in docs.collect()])
    assert np.allclose(model.centre, rows.mean(0)) and np.allclose(model.scale, quality.usable(rows.std(0)))
    latent = model.latent(rows)
    assert model.threshold == pytest.approx(np.quantile(latent, len(bad) / len(rows)))
    assert set(np.argsort(latent)[:3]) == set(bad)


def test_ranking_is_the_best_of_its_pairs():
    """Newton's weights against plain gradient descent on the same pairs' loss."""
    rnd = np.random.default_rng(4)
    good, bad = rnd.normal(0.4, 1, (40, 3)), rnd.normal(0, 1, (30, 3))
    model = quality.fit_pairs(good, bad, 500, 0.3)
    z = lambda x: np.clip((x - model.centre) / model.scale, -8, 8)
    spread = np.random.default_rng(7)
    index = [np.concatenate([spread.permutation(len(x)) for _ in range(-(-500 // len(x)))])[:500] for x in (good, bad)]
    d, w = z(good)[index[0]] - z(bad)[index[1]], np.zeros(3)
    for _ in range(20_000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / 500 - quality.RIDGE * w)
    assert np.allclose(model.weights, w, atol=1e-4)
    below = np.concatenate([model.score(good), model.score(bad)]) < 0.3
    assert abs(below.sum() - len(bad)) <= 1


@pytest.mark.parametrize("k", [1, 5])
def test_kmeans_of_equal_rows(k):
    assert len(ivfpq.kmeans(np.ones((9, 3), np.float32), k)) == 1


def test_queries_that_lie_elsewhere_than_most_rows(spark, tmp_path):
    """Rows in tight groups whose neighbours share a list, queries between the groups whose neighbours don't."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 16))[rng.integers(0, 80, 6000)] * 10 + rng.normal(size=(6000, 16)) * 0.05
    x[::100] = rng.normal(size=(60, 16)) * 10
    spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ivfpq.op6_nearest(spark, str(tmp_path)).toPandas()
    d = np.sqrt(((x[:, None, :] - x[None, ::100, :]) ** 2).sum(2))
    d[np.arange(0, 6000, 100), np.arange(60)] = np.inf
    found = [len(set(got.loc[got["query_id"] == 100 * i, "vec_id"]) & set(np.argsort(d[:, i])[:10])) for i in range(60)]
    assert np.mean(found) >= 9
