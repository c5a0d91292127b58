"""Line dedup, substring dedup and near-duplicates: odd rows, and brute force on small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from secflow.llm import line_dedup, minhash, substring

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_lines string, extra int"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd_rows():
    return [(1, None, "x", 1), (2, "", None, 2), (3, "a", "x", 3), (3, "a", "x", 3), (None, "null id", "x", 4), (4, "word " * 40_000, "x", 5), (5, " \n\t\n", "x", 6), (None, None, None, None)]


def test_lines_against_brute_force(spark):
    rnd = random.Random(3)
    pool = [f"  Line {i} É " if i % 2 else f"LINE {i}\t" for i in range(12)]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 6))) or None, "x", i) for i in range(60)]
    strip = lambda s: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", s)
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in strip(s))
    held = {}
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, set()).add(i)
    gone = {k for k, v in held.items() if k and len(v) >= 15}
    assert gone
    for batches in (1, 5):
        got = {r.doc_id: r for r in line_dedup.drop_frequent_lines(frame(spark, rows), min_docs=15, batches=batches).collect()}
        for i, t, *_ in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if key(x) not in gone]
            assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))


@pytest.mark.parametrize("operator", [line_dedup.drop_frequent_lines, substring.remove_repeated_spans])
def test_odd_rows(spark, operator):
    rows = odd_rows()
    got = operator(frame(spark, rows))
    assert "extra" in got.columns and got.count() == len(rows)
    assert {r.text for r in got.where("doc_id <= 2").collect()} == {""}
    assert operator(frame(spark, rows).limit(0)).count() == 0


def test_known_frequent_lines_leave_the_runs_alone(spark):
    """Every run but the first of a line is without it, and runs are merged level by level."""
    docs = frame(spark, [(n, "same\nown" + str(n), "", 0) for n in range(40)])
    runs = line_dedup.LineRuns(spark, min_docs=2, buckets=3)
    counts = line_dedup.batch_counts(line_dedup.line_hashes(docs, "text", 1), runs, 5)
    same = docs.select(F.xxhash64(F.lit("same"))).first()[0]
    for b in range(5):
        batch = spark.table(counts).where(f"batch = {b}").select("h1", "h2", "n_docs")
        assert batch.where(F.col("h1") == same).count() == 1
        before = {run for level in runs.levels for run in level}
        runs.add(batch)
        new = [run for level in runs.levels for run in level if run not in before]
        if b in (2, 4):  # batches that no merge follows
            assert spark.table(new[0]).where(F.col("h1") == same).count() == 0
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.frequent().count() == 1
    runs.close()


def test_batches_meet_runs_in_merge_joins_without_a_shuffle(spark):
    plans = []
    own = line_dedup.LineRuns.table

    def table(self, rows, *partitions):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return own(self, rows, *partitions)

    line_dedup.LineRuns.table = table
    try:
        line_dedup.op9_line_dedup(spark, SF).count()
    finally:
        line_dedup.LineRuns.table = own
    anti = [p for p in plans if "LeftAnti" in p]
    assert len(anti) == 3 and all("SortMergeJoin" in p and "Exchange" not in p for p in anti)
    assert any("FullOuter" in p and "Exchange" not in p for p in plans)


def test_rows_of_one_id_are_one_document_to_line_counts(spark):
    rows = [(7, f"twelve\nown {n}", "x", n) for n in range(12)] + [(None, "none", "x", n) for n in range(12)] + [(100 + n, "ten ids", "x", n) for n in range(10)]
    got = line_dedup.drop_frequent_lines(frame(spark, rows)).collect()
    assert {r.text for r in got if r.doc_id == 7} == {f"twelve\nown {n}" for n in range(12)}
    assert {r.text for r in got if r.doc_id is None} == {"none"}
    assert {(r.text, r.n_dropped) for r in got if (r.doc_id or 0) >= 100} == {("", 1)}


PASSAGE = "The first sentence has quite a few words here, more than ten. The second one follows it at once, as they often do! Is this the third of them, or is it not?"


def test_spans(spark):
    rows = [(1, f"Intro one is here. {PASSAGE} Outro one.", "", 0), (2, f"{PASSAGE} Something else entirely stands here.", "", 0), (3, "Nothing of it. Is repeated. At all in this text.", "", 0), (4, f"x.\n{PASSAGE}\n{PASSAGE} y.", "", 0)]
    got = {r.doc_id: r for r in substring.remove_repeated_spans(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0 and got[3].text == rows[2][1]
    assert got[2].text == "Something else entirely stands here." and got[2].n_removed == 3
    assert got[4].text == "x.\ny." and got[4].n_removed == 6


def test_spans_leave_other_rows_of_an_id_alone(spark):
    other = "Some text of its own stands here, and nothing repeats it. It has a second sentence, too. And here comes a third one, which ends it."
    rows = [(1, PASSAGE, "", 0), (5, PASSAGE, "", 1), (5, other, "", 2), (None, other.upper() + " More.", "", 3), (None, PASSAGE + " Rest.", "", 4), (None, "Short one. Two. Three of them.", "", 5)]
    got = {r.extra: (r.text, r.n_removed) for r in substring.remove_repeated_spans(frame(spark, rows)).collect()}
    assert got[0] == (PASSAGE, 0) and got[1] == ("", 3) and got[2] == (other, 0)
    assert got[3] == ("More.", 3) and got[4] == ("Rest.", 3) and got[5] == (rows[5][1], 0)


def test_spans_of_few_or_long_sentences(spark):
    long = " ".join(f"word{i}" for i in range(60))  # one piece, long enough by itself
    two = " ".join(f"left{i}" for i in range(28)) + ". " + " ".join(f"right{i}" for i in range(28)) + "."
    inside = ", ".join(" ".join(f"c{i}x{j}" for j in range(9)) for i in range(8))  # a passage inside one long sentence
    rows = [(1, long, "", 0), (2, "Own start.\n" + long, "", 0), (3, two, "", 0), (4, two, "", 0), (5, f"Here it, {inside}, goes on.", "", 0), (6, f"There again, {inside}, it does not.", "", 0)]
    got = {r.doc_id: r for r in substring.remove_repeated_spans(frame(spark, rows)).collect()}
    assert [got[i].n_removed for i in (1, 3, 5)] == [0, 0, 0]
    assert got[2].text == "Own start.\n" and got[4].text == "" and got[6].n_removed == 8


def brute_spans(rows):
    """Tokens by plain loops: (doc_id, text) pairs with distinct ids to (text kept, pieces removed)."""
    cut = {}
    for i, t in rows:
        parts = []
        for s in re.findall(r"(?s).*?(?:[.!?][\x20\x09-\x0d]|\n|\Z)", t):
            parts += [x for x in (re.findall(r"(?s).*?(?:[.!?,;:][\x20\x09-\x0d]|\n|\Z)", s) if len(s.split()) > 30 else [s]) if x]
        cut[i] = parts
    spans = {}
    for i in sorted(cut):
        own = [(n, p.strip().lower()) for n, p in enumerate(cut[i]) if p.strip()]
        for a in range(len(own)):
            for b in range(a, len(own)):
                words = sum(len(k.split()) for _, k in own[a : b + 1])
                if words >= 50 or (b - a >= 2 and words >= 25):
                    spans.setdefault(tuple(k for _, k in own[a : b + 1]), []).append((i, own[a][0], own[b][0]))
                    break
    gone = {i: set() for i in cut}
    for places in spans.values():
        for i, s, e in places[1:]:
            gone[i] |= set(range(s, e + 1))
    return {i: ("".join(p for n, p in enumerate(parts) if n not in gone[i]), sum(1 for n, p in enumerate(parts) if n in gone[i] and p.strip())) for i, parts in cut.items()}


def test_spans_against_brute_force(spark):
    rnd = random.Random(5)
    pool = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.choice([2, 6, 12, 35, 55]))) + rnd.choice([". ", "! ", "?\n", ", and so. ", " \n\n"]) for _ in range(25)]
    rows = []
    for i in range(120):
        at = rnd.randrange(20)
        rows.append((i, "".join(rnd.choices(pool, k=rnd.randint(0, 3)) + pool[at : at + rnd.randint(0, 5)] + rnd.choices(pool, k=rnd.randint(0, 2))).title()))
    want = brute_spans(rows)
    got = {r.doc_id: (r.text, r.n_removed) for r in substring.remove_repeated_spans(frame(spark, [(i, t, "", 0) for i, t in rows])).collect()}
    assert got == want and sum(n for _, n in want.values()) > 100


def brute(rows, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    one, two = sorted((find(a), find(b)))
                    root[two] = one
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("region,block", [(32, 256), (2, 5), (1, 2)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, region, block):
    """The other cases take crowded regions whole and compare families by pivots, in several blocks."""
    monkeypatch.setattr(minhash, "REGION", region)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(11)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{rnd.randint(0, 500)}" for _ in range(rnd.choice([3, 8, 60, 150]))]
        for _ in range(rnd.choice([1, 3, 20])):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 9)}"
            rows.append((n, " ".join(words).upper() if n % 2 else "\n".join(words), "", 0))
            n += 1
    line = [f"c{i}" for i in range(240)]  # a chain: neighbours are linked, the ends are far apart
    for at in range(0, 90, 6):
        rows.append((n, " ".join(line[at : at + 150]), "", 0))
        n += 1
    want = brute(rows, 85)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.keep_one_of_each(frame(spark, rows)).count() == len({c for _, c in want.values()})


def test_near_duplicates_odd_rows(spark):
    found = minhash.near_duplicates(frame(spark, odd_rows()))
    assert found.columns == ["doc_id", "n_lines", "extra", "n_shingles", "component_id", "kept"]
    got = found.collect()
    assert sorted(r.extra or 0 for r in got) == sorted(r[3] or 0 for r in odd_rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(1, 3, True)] * 2 and by[4] == [(1, 4, True)]
    assert sorted(by[None], key=str) == sorted([(1, None, True), (0, None, True)], key=str)
    assert minhash.near_duplicates(frame(spark, odd_rows()).limit(0)).count() == 0


def test_words_of_odd_texts():
    assert len(minhash.word_hashes("a\x0bB  c\x1cd")) == 3
    assert (minhash.shingles("A b\tC") == minhash.shingles("a B\nc")).all()
    long = "x" * 3_000_000
    assert len(minhash.word_hashes(f"{long} y {long}")) == 3
    assert minhash.word_hashes(long)[0] == minhash.word_hashes(f" {long} z")[0]
