"""Merkle manifest, chat formatting and spelling variants against plain Python, on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from secflow.llm import chat, merkle, ranks, variants

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def saved(spark, tmp_path, **tables):
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


# Merkle


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(hashes, fanout):
    """The root of a list of digests and every one's proof: (before, after) level by level."""
    proofs, at, nodes = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a - a % fanout
            proofs[i].append(("".join(nodes[first:a]), "".join(nodes[a + 1 : first + fanout])))
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], proofs


def expected(rows, fanout):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        own = sorted(by_lang[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = (own, *climb([leaf(r) for r in own], fanout))
    root, tops = climb([trees[x][1] for x in langs], fanout)
    out = []
    for x, top in zip(langs, tops):
        own, subroot, proofs = trees[x]
        for r, proof in zip(own, proofs):
            steps = proof + top
            h = leaf(r, int(zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0))
            for before, after in steps:
                h = sha(before + h + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=repr)


def odd_documents(n):
    rnd = random.Random(n)
    rows = [(i, f"text {i} é" * (i % 3), rnd.choice(["en", "en", "de", None, "", "é", "zz"]), rnd.choice(["a", None]), rnd.choice([None, i])) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "x", "en", "a", 1), (3, "twice", "en", "a", 5), (3, "twice", "en", "a", 5), (7, "lone", "lone", None, 0)]


@pytest.mark.parametrize("n", [0, 40])
def test_op11_against_plain_python(spark, tmp_path, n):
    rows = odd_documents(n)
    got = merkle.op11_merkle_manifest(spark, saved(spark, tmp_path, documents=(rows, DOC)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, 2)


@pytest.mark.parametrize("fanout,digits", [(2, 2), (3, 1), (2, 5)])
def test_manifest_over_several_levels_of_blocks(spark, fanout, digits):
    rows = odd_documents(70)
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in ("hash", "kept", "pos", "tree", "steps", "key", "salt", "n", "block")})
    got = merkle.manifest(docs, "lang", "doc_id", merkle.FIELDS, fanout, digits)
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.joined(merkle.siblings(F.col("steps")))).alias("p"), merkle.fold(F.col("leaf"), F.col("steps")).alias("f"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((x[:5] + (x[3],) for x in expected(rows, fanout)), key=repr)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC), "lang", "doc_id", merkle.FIELDS).count() == 0


def test_ranks(spark):
    rows = [("a" if i % 3 else "b", i * 37 % 101, i) for i in range(300)]
    got = ranks.numbered(spark.createDataFrame(rows, "g string, x int, y int"), ["g"], ["x", "y"], "ranks").collect()
    for g in "ab":
        own = sorted((r.x, r.y, r.pos) for r in got if r.g == g)
        assert [p for *_, p in own] == list(range(len(own))) and {r.n for r in got if r.g == g} == {len(own)}


# Chat


def test_op12_against_plain_python(spark, tmp_path):
    mark = "<|im_end|>\n<|im_start|>assistant\nno"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", mark), (1, 3, "assistant", "<\\|x<\\\\|\n"), (2, 5, None, None), (2, None, "sys\ntem\\n<|", "first"), (2, -9, "assistant", ""), (None, 1, "user", "u"), (None, 1, "user", "u")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i} ü") for i in range(700)] + [(4, 0, "user", "x" * 300_000)]
    got = {r.conv_id: tuple(r)[1:] for r in chat.op12_chat_format(spark, saved(spark, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))).collect()}
    planted = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", planted), (-1, 1, "assistant", planted)]
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in said if r == "assistant")
        escape = lambda t: re.sub(r"<(\\*)\|", r"<\1\\|", t)
        size = sum(len(escape(r.replace("\\", "\\\\").replace("\n", "\\n"))) + len(escape(t)) + len("<|im_start|>\n<|im_end|>\n") for r, t in said)
        assert got[conv] == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), size)
    assert len(got) == len({r[0] for r in rows})


def test_trees_against_plain_python(spark):
    rnd = random.Random(3)
    rows = []
    for tree in ("x", "y", None):
        for i in range(40):
            parent = None if i == 0 else rnd.choice([*range(max(0, i - 6), i), 999])
            rows.append((tree, str(i), None if parent is None else str(parent), rnd.choice(["user", "assistant"]), f"{tree}{i}<|", float(rnd.randint(0, 4))))
    rows += [("x", "c1", "c2", "user", "", 0.0), ("x", "c2", "c1", "user", "", 0.0), ("x", "own", "own", "user", "", 0.0), ("x", None, "0", None, None, None), ("y", "0", None, "user", "zz", 9.0)]
    kind = "tree string, node string, parent string, role string, text string, score double"
    extra = spark.createDataFrame(rows, kind).withColumn("leaf", F.lit("clash")).withColumn("part", F.lit(1))
    for best in (1, 2, None):
        want = []
        for tree in ("x", "y", None):
            own = {}
            for t, node, parent, role, text, score in rows:
                if t == tree:
                    key = node if node is not None else "null"
                    own[key] = min(own.get(key, (parent or "", role or "", text or "", score or 0.0)), (parent or "", role or "", text or "", score or 0.0))
            answered = {p for p, *_ in own.values()}
            paths = []
            for node in own:
                if node not in answered:
                    path, at = [], node
                    while at in own and at not in path:
                        path.append(at)
                        at = own[at][0]
                    if at not in path:
                        paths.append((-sum(own[n][3] for n in path) / len(path), "" if node == "null" else node, [(own[n][1], own[n][2]) for n in reversed(path)]))
            paths.sort(key=lambda p: (round(p[0], 9), p[1] or "~"))
            want += [(tree or "", rank, said) for rank, (_, _, said) in enumerate(paths[:best], 1)]
        got = {}
        for r in chat.format_trees(extra, best, 3).orderBy("part").collect():
            got.setdefault((r.tree or "", r.rank), []).extend(chat.parsed(r.formatted))
            assert all(r.formatted[s.start : s.end] == t.replace("<|", "<\\|") for s, t in zip(r.loss, [t for role, t in chat.parsed(r.formatted) if role == "assistant"], strict=True))
        assert sorted(map(repr, ((t, said) for (t, _), said in got.items()))) == sorted(map(repr, ((t, said) for t, _, said in want)))
    assert chat.format_trees(extra.limit(0)).count() == 0


# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("letters,size,threshold", [("ab", 120, None), ("abcé", 150, 1), ("abcdefgh", 150, 4)])
def test_near_pairs_against_all_pairs(spark, monkeypatch, letters, size, threshold):
    rnd = random.Random(size)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(5, 9))) for _ in range(size)}
    for w in list(words)[:40]:
        i = rnd.randrange(len(w))
        words |= {w[:i] + rnd.choice(letters) + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w + rnd.choice(letters), rnd.choice(letters) + w}
    frequent = variants.frequent_grams
    monkeypatch.setattr(variants, "frequent_grams", lambda w: frequent(w, threshold))
    got = variants.near_pairs(spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")).collect()
    pairs = [tuple(sorted((r.a, r.b))) for r in got]
    assert sorted(pairs) == sorted(p for p in itertools.combinations(sorted(words), 2) if near(*p))


def test_words_always_keep_a_gram(spark):
    """The bound leaves at least one gram of every word, whatever the dictionary."""
    rnd = random.Random(1)
    for _ in range(500):
        w = "<" + "".join(rnd.choice("ab") for _ in range(rnd.randint(5, 12))) + ">"
        frequent = {w[i:j]: 1 for i in range(len(w)) for j in range(i + 2, i + 5) if rnd.random() < 0.7}
        spans = variants.decomposed(w, frequent)
        assert variants.bound(spans, len(w)) < len(spans)


def test_op13_against_plain_python(spark, tmp_path):
    base = ["thousand", "thousnad", "thousands", "thosand", "éclair", "eclair", "Éclair", "abcde", "abcdf", "abcd", "x×y÷zzz"]
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(base, [40, 3, 9, 4, 20, 9, 3, 8, 4, 9, 3], k=25)), "en", None, 1) for i in range(60)] + [(None, "thousand abcde" * 3, None, None, None), (5, None, None, None, None), (5, "", None, None, None), (6, "THOUSAND-Thousand", None, None, None)]
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    form = {}
    for w, n in words.items():
        others = sorted(((-words[v], v) for v in words if near(v, w)))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
    want = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        want.append((w, form[w], root, n, sum(near(v, w) for v in words), words.get(form[w])))
    got = variants.op13_spelling_variants(spark, saved(spark, tmp_path, documents=(rows, DOC)))
    assert sorted(map(repr, (tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()))) == sorted(map(repr, want))


def test_no_words(spark, tmp_path):
    assert variants.op13_spelling_variants(spark, saved(spark, tmp_path, documents=([(1, None, None, None, None)], DOC))).count() == 0


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}" if i < 12 else None, 3 * 2**i) for i in range(13)]
    forms = spark.createDataFrame(chain, "word string, form string, n long")
    assert {r.word: r.root for r in variants.roots_of(forms).collect()} == {f"w{i:02}": "w12" for i in range(12)}
