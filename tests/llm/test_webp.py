"""The decoder against pictures written bit by bit from the format's rules."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from secflow.llm import webp
from secflow.llm.webp import BitWriter


def simple(w: BitWriter, *symbols: int) -> None:
    """A simple prefix code of one or two symbols (bits 0 and 1 in rising order)."""
    w.put(1, 1)
    w.put(len(symbols) - 1, 1)
    w.put(1, 1)
    w.put(symbols[0], 8)
    if len(symbols) == 2:
        w.put(symbols[1], 8)


def normal(w: BitWriter, lengths: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """A normal prefix code, each length stored with four bits; returns symbol to (bits, number of bits)."""
    w.put(0, 1)
    w.put(15, 4)
    for s in webp.CODE_LENGTH_ORDER:
        w.put(4 if s < 16 else 0, 3)
    w.put(0, 1)
    for s in range(size):
        w.put(int(format(lengths.get(s, 0), "04b")[::-1], 2), 4)
    code, previous, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - previous
        previous = n
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code += 1
    return out


def start(width: int, height: int) -> BitWriter:
    w = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def done(w: BitWriter) -> bytes:
    return webp.riff(w.value.to_bytes(-(-w.at // 8), "little"))


def flat(w: BitWriter, argb: int) -> None:
    """An entropy-coded image of one colour (no cache; not the main image)."""
    w.put(0, 1)
    for symbol in ((argb >> 8) & 255, (argb >> 16) & 255, argb & 255, argb >> 24):
        simple(w, symbol)
    simple(w, 0)


def main(w: BitWriter, greens: list[int], red: int = 0, blue: int = 0, alpha: int = 255) -> None:
    """The main image: green of two values, the other channels of one."""
    w.put(0, 1 + 1)
    low, high = sorted(set(greens)) if len(set(greens)) == 2 else (greens[0], greens[0] + 1)
    simple(w, low, high)
    for s in (red, blue, alpha):
        simple(w, s)
    simple(w, 0)
    for g in greens:
        w.put(int(g == high), 1)


def test_round_trips():
    for raw in (b"", b"a", b"x" * 63, os.urandom(6400), bytes(range(256)) * 3, "é漢😀".encode() * 50):
        text = raw.decode("latin-1")
        media, n, stored = webp.pack(text)
        assert webp.unpack(media, stored) == text.encode() + b"\0" * (stored - n) and stored % 64 == 0 and stored >= 64
    media, n, stored = webp.pack("abc " * 300_000)
    assert webp.decode(media).shape[0] <= webp.MAX_SIDE and webp.unpack(media, stored)[:n] == b"abc " * 300_000


def test_subtract_green():
    w = start(2, 1)
    w.put(1, 1), w.put(webp.SUBTRACT_GREEN, 2), w.put(0, 1)
    main(w, [10, 20], red=250, blue=1)
    assert [hex(p) for p in webp.decode(done(w))[0]] == ["0xff040a0b", "0xff0e1415"]


def test_palette_of_two_colours_packs_eight_pixels():
    w = start(10, 1)
    w.put(1, 1), w.put(webp.PALETTE, 2), w.put(1, 8)
    # Two palette entries, the second as a difference: 0xff000000 and + 0x00000102.
    w.put(0, 1)
    simple(w, 0, 1), simple(w, 0), simple(w, 0, 2), simple(w, 0, 255), simple(w, 0)
    w.put(0b100, 3), w.put(0b011, 3)
    w.put(0, 1)
    main(w, [0b10110001, 0b10])
    want = [(0b10110001 >> i) & 1 for i in range(8)] + [0, 1]
    assert [int(p == 0xFF000102) for p in webp.decode(done(w))[0]] == want


def test_cross_colour():
    w = start(2, 1)
    w.put(1, 1), w.put(webp.CROSS_COLOUR, 2), w.put(0, 3)
    flat(w, 0xFF << 24 | 32 << 16 | 64 << 8 | (256 - 32))  # red to blue 1, green to blue 2, green to red -1
    w.put(0, 1)
    main(w, [10, 20], red=100, blue=5)
    c = [((p >> 16) & 255, (p >> 8) & 255, p & 255) for p in webp.decode(done(w))[0].tolist()]
    assert c == [(90, 10, 5 + 20 + 90), (80, 20, 5 + 40 + 80)]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    rng = np.random.default_rng(mode)
    greens = [int(g) for g in rng.choice([7, 200], 20)]
    w = start(5, 4)
    w.put(1, 1), w.put(webp.PREDICTOR, 2), w.put(0, 3)
    flat(w, mode << 8)
    w.put(0, 1)
    main(w, greens, red=3, blue=250, alpha=0)
    got = webp.decode(done(w))
    # Plain-number model of the green channel and the others, pixel by pixel.
    rows = [[None] * 5 for _ in range(4)]
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    for y in range(4):
        for x in range(5):
            if not x and not y:
                p = [255, 0, 0, 0]
            elif not y:
                p = rows[0][x - 1]
            elif not x:
                p = rows[y - 1][0]
            else:
                a, b, c = rows[y][x - 1], rows[y - 1][x], rows[y - 1][x - 1]
                d = rows[y - 1][x + 1] if x < 4 else rows[y][0]
                clip = lambda v: max(0, min(255, v))
                near = sum(abs(b[i] - c[i]) for i in range(4)) < sum(abs(a[i] - c[i]) for i in range(4))
                m = half(a, b)
                p = [[255, 0, 0, 0], a, b, d, c, half(half(a, d), b), half(a, c), m, half(c, b), half(b, d), half(half(a, c), half(b, d)), a if near else b, [clip(a[i] + b[i] - c[i]) for i in range(4)], [clip(m[i] + int((m[i] - c[i]) / 2)) for i in range(4)]][mode]
            own = [0, 3, greens[5 * y + x], 250]
            rows[y][x] = [(s + t) & 255 for s, t in zip(own, p, strict=True)]
    want = [[a << 24 | r << 16 | g << 8 | b for a, r, g, b in row] for row in rows]
    assert got.tolist() == want


def test_back_references_and_colour_cache():
    w = start(4, 3)
    w.put(0, 1)  # no transform
    w.put(1, 1), w.put(2, 4)  # a cache of four colours
    w.put(0, 1)
    hashes = lambda p: (p * 0x1E35A7BD & 0xFFFFFFFF) >> 30
    first = 0xFF000A00
    other = next(g for g in range(11, 99) if hashes(0xFF000000 | g << 8) != hashes(first))
    second = 0xFF000000 | other << 8
    slot = 280 + hashes(first)
    green = normal(w, {10: 2, other: 2, 256 + 4: 2, slot: 2}, 284)
    simple(w, 0), simple(w, 0), simple(w, 255)
    distance = normal(w, {0: 1, 1: 1}, 40)
    for s in (10, other, slot):
        w.put(*green[s])
    w.put(*green[256 + 4]), w.put(0, 1), w.put(*distance[1])  # five pixels from one to the left (code 2)
    w.put(*green[other])
    w.put(*green[slot]), w.put(*green[10]), w.put(*green[other])
    assert webp.decode(done(w)).reshape(-1).tolist() == [first, second, first, *[first] * 5, second, first, first, second]


def test_meta_prefix_codes():
    w = start(8, 4)
    w.put(0, 1 + 1), w.put(1, 1), w.put(0, 3)  # no transform, no cache, groups by blocks of four
    w.put(0, 1)
    simple(w, 0, 1), simple(w, 0), simple(w, 0), simple(w, 0), simple(w, 0)
    w.put(0b10, 2)
    for g in (30, 40):
        simple(w, g), simple(w, 0), simple(w, 0), simple(w, 255), simple(w, 0)
    got = webp.decode(done(w))
    assert (got[:, :4] == 0xFF001E00).all() and (got[:, 4:] == 0xFF002800).all()


def test_broken_files():
    media, _, _ = webp.pack("some text")
    for bad in (b"", b"RIFF" + media[4:8] + b"XXXX" + media[12:], media[:40]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_operator(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "same", None), (3, "same", "x"), (None, "é" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    one = webp.store_and_read(docs.drop("media")).drop("text").collect()
    two = webp.read_media(webp.store_texts(docs)).select(*[c for c in one[0].asDict()]).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 5
    assert len({r.media_sha256 for r in one}) == 3 and {r.n_bytes for r in one} == {0, 4, 200_000}
    assert webp.store_and_read(docs.limit(0)).count() == 0
    assert webp.store_texts(docs).where(F.col("media").isNull()).count() == 0


def test_texts_of_documents_use_the_method(spark, monkeypatch):
    """Palette, prefix codes of several lengths and back-references; reading in bulk equals reading symbol by symbol."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["ab" * 400, "abcabd" * 300 + "x", "".join(chr(32 + (i * i) % 90) for i in range(5000)), "word " * 60_000]
    seen = {"palette": 0, "copies": 0, "lengths": 0}
    invert, bulk = webp.invert_palette, webp._bulk_tokens

    def palette(*args):
        seen["palette"] += 1
        return invert(*args)

    def tokens(bits, codes, count, width):
        seen["copies"] += any(codes[0].lengths[256:])
        seen["lengths"] += len({n for n in codes[0].lengths if n}) > 1
        return bulk(bits, codes, count, width)

    monkeypatch.setattr(webp, "invert_palette", palette)
    monkeypatch.setattr(webp, "_bulk_tokens", tokens)
    made = [webp.pack(t) for t in texts]
    assert [webp.unpack(m, n) for m, _, n in made] == [(t or "").encode().ljust(n, b"\0") for t, (_, _, n) in zip(texts, made, strict=True)]
    assert seen["palette"] == len(texts) and seen["copies"] > len(texts) * 0.8 and seen["lengths"] > len(texts) * 0.8
    assert sum(len(m) for m, _, _ in made) < 0.6 * sum(n for _, _, n in made)
    monkeypatch.setattr(webp, "CHUNK", 999)
    in_parts = [webp.decode(m) for m, *_ in made[:40]]
    monkeypatch.setattr(webp, "_bulk_tokens", lambda *args: None)
    assert all((webp.decode(m) == p).all() for (m, *_), p in zip(made, in_parts, strict=False))
