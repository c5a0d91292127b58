"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A text is cut at the special tokens and by the pre-token pattern of byte-level vocabularies;
known words come from a bounded table. Within one
pre-token the encoder walks from the left: it asks the automaton for the longest token that
starts at the position, and keeps it only if the
pair (previous token, token) is compatible, that is, if merging the two tokens' bytes by
rank gives just these two tokens again. Otherwise it tries the next shorter token, and
steps back if none is left; positions that were left this way are never entered twice, so
the work is linear. A sequence whose neighbours are all compatible is the merge result
itself, so the ids are exact. The pair table, which names the part of a match that fits, fills as
pairs are first met.

Decoding gathers each token's bytes from one buffer by an (offset, length) table.

Rows: a null text is an empty text (no ids, empty decoded text); repeated rows and ties
keep one output row each; other columns pass through, except that names the operator
itself adds are replaced; an empty table gives an empty table. Texts of any length are
encoded whole: memory is bounded by the text and the two bounded caches.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from secflow.llm.common import read

#: Bounds of the per-worker caches; a full cache is dropped and refilled, longer keys are not kept; results do not change.
MAX_WORDS, MAX_KEY, MAX_PAIRS = 600_000, 64, 1_000_000
#: The pre-token pattern for texts of ASCII characters only.
_ASCII_WORDS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
_FAR = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, free = {b: chr(b) for b in shown}, 0x100
    for b in range(0x100):
        if b not in table:
            table[b] = chr(free)
            free += 1
    return [table[b] for b in range(0x100)]


class Words(dict):
    """Pre-token to its ids as little-endian bytes; misses are encoded on first use. A full table becomes the old one; words met again come back from it."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        if len(word) <= MAX_KEY:
            if len(self) >= MAX_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


def _plane_words() -> Callable[[str], list[str]]:
    """The pre-token pattern for texts of the basic plane, whose classes are written out, as the standard library has none of them."""
    import regex

    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    letter, digit, space = ("".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(rf"{kind}+", plane)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+").findall


class BacktrackingBpe:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self._alphabet = "".join(alphabet)
        to_byte = {c: b for b, c in enumerate(alphabet)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        size = max([*vocab.values(), *self.special.values()]) + 1

        #: pair of ids -> (rank, merged id); a token's parts and the rank that made it.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        for rank, (a, b) in enumerate(merges):
            one, two, made = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((one, two), (rank, made))
            if self.left[made] < 0:
                self.left[made], self.right[made], self.rank[made] = one, two, rank

        self._vocab = vocab
        self._matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in vocab.items():
            self._matches.add_word(token, i)
        self._matches.make_automaton()
        self._length = [0] * size
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(to_byte[c] for c in token)
            self._length[i] = len(token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        # The next shorter token that is a prefix of a token, -1 for none.
        self._shorter = [-1] * size
        for token, i in vocab.items():
            for n in range(len(token) - 1, 0, -1):
                if (j := vocab.get(token[:n])) is not None:
                    self._shorter[i] = j
                    break
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        #: (token before, longest match) -> what of the match fits; edges of tokens, left and right of a border.
        self._picks: dict[int, int] = {}
        self._edge_left: dict[int, list[int]] = {}
        self._edge_right: dict[int, list[int]] = {}
        self._size = size
        self._decimal = list(map(str, range(size)))
        self.words = Words(lambda word: array("i", self.encode_word(word)).tobytes())
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._split, self._split_plane = regex.compile(pattern).findall, _plane_words()
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of token a then token b by rank leaves just the tokens a, b.

        Only tokens on the facing edges of a and b can merge across the border. Both edges
        start as bytes and grow when their own merges come due; a merge across the border
        happens if its rank comes before the rank at which either side grows (at equal rank
        the leftmost pair merges first).
        """
        edge_a, edge_b = self._edge_left.get(a) or self._edge(self._edge_left, self.right, a), self._edge_right.get(b) or self._edge(self._edge_right, self.left, b)
        i, j, merge, rank = len(edge_a) - 1, len(edge_b) - 1, self.merge.get, self.rank
        while True:
            grow_a = rank[edge_a[i - 1]] if i else _FAR
            grow_b = rank[edge_b[j - 1]] if j else _FAR
            across = merge((edge_a[i], edge_b[j]))
            if across is not None and across[0] < grow_a and across[0] <= grow_b:
                return False
            if not i and not j:
                return True
            if grow_a <= grow_b:
                i -= 1
            else:
                j -= 1

    @staticmethod
    def _edge(edges: dict[int, list[int]], inner: list[int], token: int) -> list[int]:
        """The token, its part at the border, that one's part there, and so on down to a byte; kept, as there are no more than tokens."""
        found = [token]
        while inner[found[-1]] >= 0:
            found.append(inner[found[-1]])
        edges[token] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        text = charmap_decode(word.encode("utf-8", "surrogatepass"), "strict", self._alphabet)[0]
        longest, lengths, size, known = self._matches.iter_long, self._length, self._size, self._picks.get
        # Until a word first steps back no position is dead: each longest match, or the prefix of it that fits, is taken.
        out: list[int] = []
        last, scan = -1, longest(text)
        while True:
            for end, token in scan:
                fit = known(last * size + token)
                if fit is None:
                    fit = self._pick(last, token)
                if fit != token:
                    break
                out.append(token)
                last = token
            else:
                return out
            pos = end + 1 - lengths[token]
            if fit < 0:
                break
            out.append(fit)
            last = fit
            scan = longest(text, pos + lengths[fit])
        n, shorter, dead = len(text), self._shorter, bytearray(len(text) + 1)
        # One scan serves as long as the longest matches are taken; after any other token a new one starts.
        whole = False
        while True:
            if fit < 0:
                dead[pos] = 1
                token = out.pop()
                pos -= lengths[token]
                last, token, whole = out[-1] if out else -1, shorter[token], False
            elif dead[pos + lengths[fit]]:
                token, whole = shorter[fit], False
            else:
                out.append(fit)
                last = fit
                pos += lengths[fit]
                if pos == n:
                    return out
                if not whole or fit != token:
                    scan, whole = longest(text, pos), True
                token = next(scan)[1]
            if token < 0:
                fit = -1
                continue
            fit = known(last * size + token)
            if fit is None:
                fit = self._pick(last, token)

    def _pick(self, last: int, token: int) -> int:
        """The longest of a token and its prefixes that is compatible with the token before (-1 at the start), -1 if none is."""
        fit, compatible, shorter = token, self.compatible, self._shorter
        while last >= 0 <= fit and not compatible(last, fit):
            fit = shorter[fit]
        if len(self._picks) >= MAX_PAIRS:
            self._picks.clear()
        self._picks[last * self._size + token] = fit
        return fit

    def _of_words(self, text: str) -> bytes:
        """Ids of a text without special tokens, pre-token by pre-token."""
        if text.isascii():
            split = _ASCII_WORDS
        else:
            split = self._split_plane if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self._split
        return b"".join(map(self.words.__getitem__, split(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not any(s in text for s in self.special):
            return np.frombuffer(self._of_words(text), "<i4")
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += [self._of_words(text[at : m.start()]), array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._of_words(text[at:])]), "<i4")

    def decimal(self, ids: np.ndarray) -> str:
        """The ids as decimal text, joined by commas."""
        return ",".join(map(self._decimal.__getitem__, ids.tolist()))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids, gathered by the offset table; unknown ids give nothing."""
        ids = ids[(ids >= 0) & (ids < self._size)]
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total, dtype=np.int64) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.buffer[index].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODECS: dict[str, BacktrackingBpe] = {}


def codec(path: str) -> BacktrackingBpe:
    """The codec of a vocabulary file, built once in each worker."""
    if path not in _CODECS:
        _CODECS[path] = BacktrackingBpe(path)
    return _CODECS[path]


def _others(schema: T.StructType, added: list[str]) -> list[str]:
    return [f.name for f in schema.fields if f.name not in added]


def _map(docs: DataFrame, added: T.StructType, make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``docs`` with the columns of ``added``, computed batch by batch; same-named columns are replaced."""
    kept = _others(docs.schema, added.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *make(batch)], [*kept, *added.names])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *added.fields]))


def _lists(found: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(found) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat, pa.int32()))


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Adds the token ids of column ``text`` as array<int>."""

    def make(batch: pa.RecordBatch) -> list:
        bpe = codec(vocabulary)
        found = [bpe.encode(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        return [_lists(found)]

    return _map(docs, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]), make)


def decode_documents(docs: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Adds the text of the ids in column ``ids``; null ids give an empty text."""

    def make(batch: pa.RecordBatch) -> list:
        bpe = codec(vocabulary)
        column = batch.column(batch.schema.get_field_index(ids))
        rows = (x.values for x in column)
        return [pa.array([bpe.decode(np.zeros(0, np.int64) if x is None else x.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)) for x in rows], pa.string())]

    return _map(docs, T.StructType([T.StructField(text, T.StringType())]), make)


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text and adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; the ids too if asked for."""
    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        added.add("token_ids", T.ArrayType(T.IntegerType()))

    def make(batch: pa.RecordBatch) -> list:
        bpe, counts, of_ids, of_text, found = codec(vocabulary), [], [], [], []
        for t in batch.column(batch.schema.get_field_index(text)):
            ids = bpe.encode(t.as_py() or "")
            counts.append(len(ids))
            if with_ids:
                found.append(ids)
            of_ids.append(hashlib.sha256(bpe.decimal(ids).encode()).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        made = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        return [*made, _lists(found)] if with_ids else made

    return _map(docs, added, make)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op5_bpe_round_trip": op5_bpe_round_trip}
ORACLES: dict[str, str] = {}
