import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from secflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library_on_random_texts(exact):
    codec, rnd = bpe.BacktrackingBpe(PATH), random.Random(5)
    alphabets = ["ab", "aab ", "abcdefghij ", "the inoa r", "é ç\n\t'sxyz 12", "日本語中 あ😀a", "   \n\n  x", "aaaa-=_+*/!?<|endoftext|>", "\x00\x1c\x1f\x85 ᠎ x"]
    for _ in range(4000):
        text = "".join(rnd.choices(rnd.choice(alphabets), k=rnd.randint(0, 40)))
        text += "<|endoftext|>" + text if rnd.random() < 0.1 else ""
        want = exact.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == want, repr(text)
        assert codec.decode(codec.encode(text)) == exact.decode(want, skip_special_tokens=False)


def test_pair_table_agrees_with_merging(exact):
    codec, rnd = bpe.BacktrackingBpe(PATH), random.Random(6)
    words = [i for t, i in codec._vocab.items() if t.isalpha() and t.isascii()]
    for _ in range(3000):
        a, b = rnd.choice(words), rnd.choice(words)
        text = codec.decode_bytes(__import__("numpy").array([a, b])).decode()
        assert codec.compatible(a, b) == (exact.encode(text, add_special_tokens=False).ids == [a, b])


def test_operator_on_odd_rows(spark, exact):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("lang", T.StringType())])
    rows = [(1, None, "x", "en"), (2, "", "x", None), (3, "a b " * 30000, "x", "en"), (3, "tie", None, "en"), (3, "tie", None, "en"), (None, "null id\n é", None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == 6 and set(got[0].asDict()) == {"doc_id", "text", "lang", "n_tokens", "ids_sha256", "decoded_sha256"}
    for r in got:
        ids = exact.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    again = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert [r.decoded for r in again] == [r.text or "" for r in again]
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
