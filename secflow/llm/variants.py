"""Groups of spelling variants: words one edit apart, found by a variable-length gram index.

Words are near if they differ by exactly one inserted, deleted or replaced code point. A
word's form is its near word of largest count, if that is at least ``ratio`` times its own;
forms are followed to the last, the root.

Method. The gram dictionary holds the grams of two to four code points of all words (marked
at both ends), pruned by frequency: a gram is lengthened only while its own frequency is
above a threshold, so frequent grams become longer, rarer ones. Each word is decomposed into
one gram for each place, the shortest one there that isn't frequent. Whether a gram is taken
depends on its own code points alone, so an edit affects just the grams that cover it; the
most grams that any one edit of a word covers is the word's bound. A word of ``g`` grams with
bound ``b`` shares at least ``g - b`` grams with every near word, so of its ``b + 1`` rarest
grams (in one order for all words) one is shared, and only their lists are merged. Words have
five code points at least and grams four at most, so ``b + 1 <= g`` always: no word falls out
of the index. A shared gram lies before the edit, and then all up to its end is shared, or
behind it, and then all from its start is; lists are keyed by that part of the word and by
the shorter word's length, which keeps them short. Candidates are verified inside the join,
so that only near pairs leave it.

Bounds: occurrences are counted with map-side combining, so a word in every document is one
row a task. The dictionary sent to tasks holds frequent grams only, and the threshold grows
with all grams, so there are 3 * 2^16 at most. Nothing is grouped by list; the join spills
and splits. The dictionary only steers speed: any threshold gives the same pairs.

Rows: null and empty texts have no words; a null doc_id counts as empty where ids matter.
Every row counts, repeated ids and texts too. Ties among forms go to the smallest word in
code-point order. Only the columns named are read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.llm.common import LOWER, UPPER, discard, materialise, read

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
SHORTEST = 5
GRAMS = (2, 4)


def runs_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, run) of every maximal run of letters of ``SHORTEST`` code points or more, A-Z lower-cased."""
    whole = F.col(text)
    # For ASCII, lower() changes just A-Z and is much faster than translate().
    lower = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run")).where(F.char_length("run") >= SHORTEST)


def with_typos(runs: DataFrame, one_in: int = 97) -> DataFrame:
    """(word): each run, less one code point where a hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.withColumn("h", h).select(F.when(F.pmod("h", F.lit(one_in)) == 0, cut).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, least: int = 3) -> DataFrame:
    """(word, n) of words of ``SHORTEST`` code points or more that occur ``least`` times or more."""
    return words.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def marked(word: Column) -> Column:
    return F.concat(F.lit("<"), word, F.lit(">"))


def frequent_grams(words: DataFrame, threshold: int | None = None) -> dict[str, int]:
    """Grams of all words with a frequency above the threshold: 16, or what keeps them to 2^16 a length."""
    w = marked(F.col("word"))
    at = lambda q: F.transform(F.sequence(F.lit(1), F.char_length(w) - (q - 1)), lambda i: F.substring(w, i, F.lit(q)))
    least, most = GRAMS
    grams = words.select(F.explode(F.concat(*(at(q) for q in range(least, most + 1)))).alias("gram"))
    if threshold is None:
        of_one_length = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
        threshold = max(16, of_one_length >> 16)
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold).toLocalIterator()}


def decomposed(word: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of the gram at each place of a marked word."""
    (least, most), end = GRAMS, len(word)
    found = []
    for p in range(end - least + 1):
        e = p + least
        while e - p < most and e < end and word[p:e] in frequent:
            e += 1
        found.append((p, e))
    return found


def bound(spans: list[tuple[int, int]], length: int) -> int:
    """The most grams that one edit can affect. A gap between two places is covered by no more grams than either."""
    cover = [0] * (length + 1)
    for p, e in spans:
        for i in range(p, e):
            cover[i] += 1
    return max(cover[1 : length - 1])


def index_keys(word: str, frequent: dict[str, int]) -> list[str]:
    """The parts of a word by which its rarest grams find near words: up to a gram's end, and from its start."""
    w = f"<{word}>"
    spans = decomposed(w, frequent)
    rarest = sorted(spans, key=lambda s: (frequent.get(w[s[0] : s[1]], 0), s[0] - s[1], w[s[0] : s[1]], s[0]))[: bound(spans, len(w)) + 1]
    # The gram's own part is named too: another gram may end or start at the same place.
    return [k for p, e in rarest for k in (f"{p}:{w[:e]}", f"{w[p:]}:{len(w) - e}")]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of near words, each pair once, the shorter or smaller word first. ``words``: distinct (word, n)."""
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pa.array([index_keys(w, frequent.value) for w in batch.column("word").to_pylist()], pa.list_(pa.string()))
            yield pa.record_batch([batch.column("word"), batch.column("n"), parts], names=["word", "n", "keys"])

    found = words.mapInArrow(keys, "word string, n long, keys array<string>")
    size = F.char_length("word")
    rows = found.select("word", "n", size.alias("size"), F.explode("keys").alias("part"))
    short = rows.select(F.xxhash64("size", "part").alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    #: The other word has the same length, or one code point more.
    long = rows.select("word", "n", "part", F.explode(F.array(F.struct("size", F.lit(True).alias("same")), F.struct((F.col("size") - 1).alias("size"), F.lit(False).alias("same")))).alias("x"))
    long = long.where(F.col("x.size") >= SHORTEST).select(F.xxhash64("x.size", "part").alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("x.same").alias("same"))
    met = short.join(long.hint("merge"), (short["key"] == long["key"]) & (~F.col("same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def forms_of(words: DataFrame, pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word: its near words' number, and the largest of them if large enough."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    large = -F.col("best.minus") >= ratio * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n"))


def roots_of(forms: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, root) of every word that has a form. Counts grow by ``ratio`` a step, so few doublings reach the last form."""
    up = materialise(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    most = forms.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(most, ratio)) + 1
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        old = up
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = materialise(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(forms.sparkSession, old)
    return up


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n)."""
    pairs = near_pairs(words)
    forms = materialise(forms_of(words, pairs, ratio), "forms")
    roots = roots_of(forms, ratio)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = materialise(count_words(with_typos(runs_of(docs))), "words")
    return spelling_variants(words)


#: crc32 of a text in DuckDB: its UTF-8 bytes one by one, eight shifts each, with the polynomial's reversed bits.
_BYTES = "flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN ascii(c) < 128 THEN [ascii(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))"
_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, " + _BYTES + "), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"

ORACLE = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS times FROM r WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, times, {_CRC32.format(x="coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM o),
t AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM t WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
k AS (SELECT word, n, i, substr(word, 1, i - 1) AS x, substr(word, i + 1) AS y FROM g),
p AS (
  SELECT a.word, b.word AS near, b.n AS m FROM k a JOIN k b ON a.i = b.i AND a.x = b.x AND a.y = b.y AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM k a JOIN w b ON b.word = a.x || a.y
  UNION
  SELECT b.word, a.word, a.n FROM k a JOIN w b ON b.word = a.x || a.y),
s AS (SELECT word, count(*) AS n_near, max(m) AS top FROM p GROUP BY word),
b AS (SELECT s.word, s.n_near, s.top, min(p.near) AS near FROM s JOIN p ON p.word = s.word AND p.m = s.top GROUP BY ALL),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.near END AS form, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
      FROM w LEFT JOIN b ON b.word = w.word),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM f JOIN c ON c.word = f.word JOIN f l ON l.word = c.root AND l.form IS NULL
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": ORACLE}
