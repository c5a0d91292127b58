"""The whole pipeline against plain Python, DuckDB and the tokenizers library, with odd rows among the documents."""

import hashlib
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import tokenizers

import corpus_pipeline
from secflow.llm import bpe, mixing
from tests.llm.test_dedup import brute

SF = "/root/testdata/sf0.001"


def documents():
    table = pq.read_table(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).to_pylist()
    own = lambda i, t, **more: {"doc_id": i, "text": t, "lang": None, "source": "src1", "n_chars": 1} | more
    plain = next(r["text"] for r in table if r["lang"] == "en" and 300 < len(r["text"]) < 2000)
    gone = [own(9001, None), own(9002, ""), own(9003, "123 !?\n"), own(9004, "Съешь ещё этих мягких французских булок да выпей чаю"), own(None, None), own(None, " \n\t", source=None)]
    stay = [own(9010, plain.upper(), source=None), own(9011, plain), own(9011, plain), own(9012, "\n".join([plain] * 400), lang="xx"), own(9013, plain.replace(" ", "  ") + "\nshared line\n shared LINE")]
    stay += [own(9020 + i, f"{r['text']}\nShared line", source="src2") for i, r in enumerate(table[:12])]
    return table, gone, stay


def test_pipeline_against_brute_force(spark, tmp_path):
    table, gone, stay = documents()
    rows = table + gone + stay
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("copy", pa.int32()), ("size", pa.string())])
    pq.write_table(pa.Table.from_pylist([r | {"copy": 1, "size": "x"} for r in rows], schema), f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs = [(r["doc_id"], r["text"], r["source"]) for r in table + stay if re.search(r"[^\W\d_]", r["text"] or "")]
    assert len(docs) > len(table) * 0.9
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t, _ in docs:
        for k in {key(x) for x in t.split("\n")} - {""}:
            held.setdefault(k, set()).add(i)
    docs = [(i, "\n".join(x for x in t.split("\n") if len(held.get(key(x), ())) < 10), s) for i, t, s in docs]
    assert not any("Shared line" in t for _, t, _ in docs)
    first = {i: component for i, (_, component) in brute(docs, 85).items()}
    docs = [d for d in docs if first[d[0]] == d[0]]
    assert 9011 not in {i for i, *_ in docs}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs], "source": [d[2] for d in docs]}))
    taken = con.execute(f"SELECT doc_id, taken, size FROM ({mixing.ORACLE}) WHERE taken > 0").fetchall()
    times = {i: -(-n // size) for i, n, size in taken}
    coder, want = tokenizers.Tokenizer.from_file(bpe.default_vocabulary()), []
    for i, t, _ in docs:
        ids = coder.encode(t, add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want += [(i, len(ids), digest, back, tuple(ids))] * times.get(i, 0)
    assert got == sorted(want)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.count() == 0
        if name != "bpe":
            assert made.columns == corpus_pipeline.COLUMNS
