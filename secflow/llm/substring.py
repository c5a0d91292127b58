"""Substring deduplication over sliding spans of sentences.

A text is cut into sentences: after every . ! or ? that white space follows, and after every
line feed. A sentence of more than ``long_words`` words is also cut at its clauses (after
, ; or : that white space follows), so that a passage that starts or ends inside it is still
found. Blank pieces belong to no span. From every piece a run of consecutive pieces grows
until it has at least ``span`` pieces and ``min_words`` words, or ``whole_words`` words in
however few pieces; every such run is hashed (128 bits, of the pieces stripped of white
space at both ends, A-Z lower-cased). Runs that occur more than once anywhere are repeated;
the occurrence with the smallest (doc_id, hash of the text, position) is the first. Pieces
covered by any other occurrence of a repeated run are removed, the rest of the text stays
as it is.

The runs are written once, five longs each. Counts and first documents are plain longs,
aggregated map-side per hash; only repeated runs are joined back to their occurrences, in a
join that Spark can split, and only positions travel to documents. A document's positions
are merged as intervals, in one pass over its pieces.

Rows: a row is known by its id and its text's hash, so rows that share an id, or have none,
never lose what another row repeats; rows equal in both are one document and lose the same.
Null ids count as the largest. Null and empty texts have no pieces and stay (a null text as
''). A text of fewer pieces than a run needs loses nothing. Other columns pass through,
same-named ones are replaced; an empty table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.llm.common import discard, materialise, read

SPAN, MIN_WORDS, WHOLE_WORDS, LONG_WORDS = 3, 25, 50, 30
SENTENCE_END = re.compile(rb"[.!?][ \t-\r]|\n")
CLAUSE_END = re.compile(rb"[.!?,;:][ \t-\r]|\n")
#: Stands for a null id, which comes last.
NO_ID = (1 << 63) - 1


def _cut(text: bytes, end: re.Pattern) -> list[bytes]:
    at, found = 0, []
    for m in end.finditer(text):
        found.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        found.append(text[at:])
    return found


def pieces(text: bytes, long_words: int = LONG_WORDS) -> list[bytes]:
    """The pieces of a text in UTF-8, white space included; joined they are the text."""
    found: list[bytes] = []
    for s in _cut(text, SENTENCE_END):
        # A word and the space after it take two bytes at least.
        if len(s) > 2 * long_words and len(s.split()) > long_words:
            found += _cut(s, CLAUSE_END)
        else:
            found.append(s)
    return found


def runs(parts: list[bytes], span: int, min_words: int, whole_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first piece, last piece, digest) of the run that starts at each piece."""
    own = [(i, k) for i, k in enumerate(p.strip().lower() for p in parts) if k]
    words = np.cumsum([0, *(len(k.split()) for _, k in own)])
    starts = np.arange(len(own))
    # The last piece of each run, by either rule; len(own) where the text ends before.
    whole = np.searchsorted(words, words[:-1] + whole_words) - 1
    short = np.maximum(np.searchsorted(words, words[:-1] + min_words) - 1, starts + span - 1)
    for a, b in zip(starts.tolist(), np.minimum(whole, short).tolist(), strict=True):
        if b < len(own):
            yield own[a][0], own[b][0], xxhash.xxh3_128_digest(b"\n".join([k for _, k in own[a : b + 1]]))


def spans(docs: DataFrame, text: str, span: int, min_words: int, whole_words: int, long_words: int) -> DataFrame:
    """(doc_id, row, start, end, h1, h2) of every run; ``row`` is the hash of the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [list(runs(pieces(t or b"", long_words), span, min_words, whole_words)) for t in part.column(2).to_pylist()]
                index = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                digests = np.frombuffer(b"".join(r[2] for f in found for r in f), "<i8").reshape(-1, 2)
                columns = [part.column(0).take(pa.array(index)), part.column(1).take(pa.array(index))]
                columns += [pa.array([r[i] for f in found for r in f], pa.int32()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], ["doc_id", "row", "start", "end", "h1", "h2"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).cast("binary").alias("text"))
    return chosen.mapInArrow(find, "doc_id long, row long, start int, end int, h1 long, h2 long")


def _stays(text: bytes, gone: list | None, long_words: int) -> tuple[bytes, int, int]:
    """What stays of a text, its pieces that aren't blank, and how many of those went."""
    parts = pieces(text, long_words)
    filled = [bool(p.strip()) for p in parts]
    if not gone:
        return text, sum(filled), 0
    drop = np.zeros(len(parts) + 1, np.int64)
    for g in gone:
        drop[g["start"]] += 1
        drop[g["end"] + 1] -= 1
    drop = np.cumsum(drop)[:-1] > 0
    return b"".join(p for p, d in zip(parts, drop, strict=True) if not d), sum(filled), int(np.count_nonzero(drop & np.array(filled, bool)))


def remove_repeated_spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, whole_words: int = WHOLE_WORDS, long_words: int = LONG_WORDS, text: str = "text") -> DataFrame:
    """``docs`` with text replaced by what stays, plus ``n_sentences`` (blank pieces not counted) and ``n_removed``."""
    found = materialise(spans(docs, text, span, min_words, whole_words, long_words).withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))), "spans")
    by_hash = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min("doc").alias("first"))
    repeated = materialise(by_hash.where("times > 1").select("h1", "h2", "first"), "repeated-spans")
    places = materialise(found.join(repeated, ["h1", "h2"]), "span-places")
    discard(docs.sparkSession, found, repeated)
    # Within the first document its first row and place is the first occurrence.
    first = places.where("doc = first").groupBy("h1", "h2").agg(F.min(F.struct("row", "start")).alias("at"))
    own = places.where("doc = first").join(first, ["h1", "h2"]).where(F.struct("row", "start") != F.col("at"))
    later = places.where("doc <> first").select("doc", "row", "start", "end").union(own.select("doc", "row", "start", "end"))
    covered = later.groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("start", "end")).alias("_gone"))
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "_doc", "_row", "_gone")]
    on = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_doc")) & (F.xxhash64(text) == F.col("_row"))
    joined = docs.select(*kept).join(covered, on, "left").select(*(F.col(c).cast("binary").alias(c) if c == text else F.col(c) for c in kept), "_gone")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, gone = batch.column(kept.index(text)), batch.column(len(kept))
            made = [_stays(t or b"", g, long_words) for t, g in zip(own.to_pylist(), gone.to_pylist(), strict=True)]
            columns = [pa.array([m[0] for m in made], pa.binary()).cast(pa.string()) if c == text else batch.column(i) for i, c in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2))], [*kept, "n_sentences", "n_removed"])

    added = [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]
    return joined.mapInArrow(remove, T.StructType([*(docs.schema[c] for c in kept), *added]))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_spans(docs).select("doc_id", "n_sentences", "n_removed", "text")


ORACLE = r"""
WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '(?s).*?(?:[.!?][\x20\x09-\x0D]|\n|\z)'), lambda x: length(x) > 0) AS sentences FROM documents),
p AS (SELECT doc_id, flatten(list_transform(sentences, lambda x: CASE WHEN len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 30
        THEN list_filter(regexp_extract_all(x, '(?s).*?(?:[.!?,;:][\x20\x09-\x0D]|\n|\z)'), lambda y: length(y) > 0) ELSE [x] END)) AS pieces FROM s),
e AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM p),
k AS (SELECT *, translate(trim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT doc_id, i, key, row_number() OVER w AS r, sum(len(regexp_extract_all(key, '[^\x20\x09-\x0D]+'))) OVER w AS upto, len(regexp_extract_all(key, '[^\x20\x09-\x0D]+')) AS n
      FROM k WHERE length(key) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, i, r, upto - n + 25 AS need, upto - n + 50 AS whole FROM f),
b AS (SELECT a.*, f.r AS r25 FROM a ASOF LEFT JOIN f ON a.doc_id = f.doc_id AND a.need <= f.upto),
c AS (SELECT b.*, f.r AS r50 FROM b ASOF LEFT JOIN f ON b.doc_id = f.doc_id AND b.whole <= f.upto),
d AS (SELECT c.doc_id, c.i AS s, c.r, z.i AS t, z.r AS l FROM c JOIN f z ON z.doc_id = c.doc_id AND z.r = least(CASE WHEN r25 IS NOT NULL THEN greatest(r25, c.r + 2) END, r50)),
sp AS (SELECT d.doc_id, d.s, d.t, string_agg(f.key, chr(10) ORDER BY f.r) AS words FROM d JOIN f ON f.doc_id = d.doc_id AND f.r BETWEEN d.r AND d.l GROUP BY d.doc_id, d.s, d.t),
firsts AS (SELECT words, min((doc_id, s)) AS f FROM sp GROUP BY words HAVING count(*) > 1),
later AS (SELECT DISTINCT doc_id, s, t FROM sp JOIN firsts USING (words) WHERE (doc_id, s) <> f),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, t + 1)) AS i FROM later)
SELECT p.doc_id, count(*) FILTER (WHERE length(k.key) > 0)::BIGINT AS n_sentences,
       count(*) FILTER (WHERE length(k.key) > 0 AND g.i IS NOT NULL)::BIGINT AS n_removed,
       coalesce(string_agg(k.piece, '' ORDER BY k.i) FILTER (WHERE g.i IS NULL), '') AS text
FROM p LEFT JOIN k ON p.doc_id = k.doc_id LEFT JOIN gone g ON k.doc_id = g.doc_id AND k.i = g.i GROUP BY p.doc_id
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES = {"op4_substring_dedup": ORACLE}
