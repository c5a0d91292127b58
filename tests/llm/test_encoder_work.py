"""What the encoder and the shards do no more often than they must, with the same ids."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from secflow.llm import bpe, token_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_a_full_table_keeps_words_that_are_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 8)
    made = []
    words = bpe.Words(lambda w: made.append(w) or w.encode())
    for i in range(40):
        assert words["common"] == b"common" and words[f"w{i}"] == f"w{i}".encode()
        assert len(words) + len(words.old) <= 8
    assert made.count("common") == 1 and len(made) == 41


def test_words_of_the_basic_plane_are_cut_alike():
    codec, rnd = bpe.BacktrackingBpe(PATH), random.Random(3)
    near = [chr(c) for c in [*range(0x300), *range(0x1680, 0x1820), *range(0x2000, 0x2200), 0x3000, 0xFEFF, 0xFFFF, *range(0xFF10, 0xFF40)]]
    for _ in range(3000):
        text = "".join(rnd.choice(near if rnd.random() < 0.5 else "a1 \n'st") if rnd.random() < 0.97 else chr(rnd.choice([*range(0x100, 0xD800), 0xE000])) for _ in range(30))
        assert codec._split_plane(text) == codec._split(text), repr(text)


def test_words_that_step_back_have_the_library_s_ids():
    codec, exact, rnd = bpe.BacktrackingBpe(PATH), Tokenizer.from_file(PATH), random.Random(4)
    parts = ["th", "ing", "er", "ß", "öi", "keit", "an", "estè", "o", "ón", "e", "sch", "one", "í"]
    for _ in range(3000):
        word = rnd.choice(["", " "]) + "".join(rnd.choices(parts, k=rnd.randint(1, 6)))
        assert codec.encode_word(word) == exact.encode(word, add_special_tokens=False).ids, word


def test_sequences_are_written_once_before_their_shards(spark, monkeypatch):
    written, real = [], token_shards.materialise
    monkeypatch.setattr(token_shards, "materialise", lambda df, name, *a: written.append(name) or real(df, name, *a))
    docs = spark.createDataFrame([(i, "word " * i) for i in range(50)], "doc_id long, text string").repartition(3)
    made = token_shards.read_from(token_shards.materialise_order(docs, PATH, length=16, per_shard=8), length=16).collect()
    assert sorted(r.slot for r in made) == list(range(len(made))) and {r.doc_id for r in made} == set(range(50))
    assert written == ["sequences"]
