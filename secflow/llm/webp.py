"""Lossless WebP: stores bytes as images and decodes any VP8L picture to its pixels.

``decode`` reads every part of the lossless format: prefix codes (simple, normal and
meta), back-references, the colour cache, and the predictor, cross-colour, subtract-green
and colour-indexing (palette) transforms, which it then inverts. Where a picture has one group
of codes and no cache, its tokens are read in bulk: what would start at every bit is looked
up at once, a walk from token to token picks those that do, and back-references are
resolved by following their sources.

``encode`` writes a picture with a palette of the byte values in use (several pixels to one
where there are few), back-references to earlier repeats of at least MATCH pixels, and
prefix codes fitted to both. The other transforms and the cache don't make texts smaller;
it writes none, and only the reader knows them.

``store_texts`` packs a text's UTF-8 bytes, padded with zeros to a positive multiple of
64, one to a pixel (as its green).

Rows: a null text is an empty text (64 zero bytes); equal texts give equal values; repeated
rows and ties keep one output row each; other columns pass through, same-named ones are
replaced; an empty table gives an empty table. Texts are stored whole: rows of 64 pixels,
wider ones where a picture would be more than 16,384 rows high.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from secflow.llm.common import read

MAX_SIDE = 16384
#: Fixed values of the format: the order in which code length codes are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (x, y) offsets of the 120 short distance codes.
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
ARGB = ("alpha", "red", "green", "blue")
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Least and most pixels of a back-reference, longest prefix code written, bits looked at at once by the reader.
MATCH, LONGEST, WIDEST, CHUNK = 8, 4096, 12, 1 << 18
#: Code lengths of the code length symbols as written: a complete code of 0, 2 .. 12 and the two runs of zeros (4 bits), 1 and 13 .. 15 (5 bits).
LENGTH_CODE = {**{n: 4 for n in (0, *range(2, 13), 17, 18)}, **{n: 5 for n in (1, 13, 14, 15)}}


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8
        self.window, self.first = int.from_bytes(data[:64], "little"), 0

    def peek(self, n: int) -> int:
        """The next n bits (32 at most) as a number; zeros follow the end."""
        if self.at - self.first > 480:
            self.first = self.at & ~7
            self.window = int.from_bytes(self.data[self.first >> 3 : (self.first >> 3) + 64], "little")
        return (self.window >> (self.at - self.first)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the picture ends early")
        return value

    def span(self, start: int, n: int) -> int:
        """The n bits from bit ``start`` on."""
        return (int.from_bytes(self.data[start >> 3 : (start + n + 7) >> 3], "little") >> (start & 7)) & ((1 << n) - 1)


@functools.cache
def reversed_bits(w: int) -> np.ndarray:
    """0 .. 2**w - 1, each with its w bits in reverse order."""
    return np.array([int(format(i, f"0{w}b")[::-1], 2) for i in range(1 << w)], np.uint16)


class PrefixCode:
    """A canonical prefix code, read through one table of its longest code's size."""

    def __init__(self, lengths: tuple[int, ...]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        self.bits = max((n for n, _ in used), default=0)
        self.fixed = len(used) > 1 and len({n for n, _ in used}) == 1
        self.lengths = lengths
        if not used:
            self.only = 0
        elif self.only is None:
            if sum(1 << (self.bits - n) for n, _ in used) != 1 << self.bits:
                raise ValueError("the prefix code isn't complete")
            # A code of n bits fills every place of the table whose n low bits are the code's, first bit lowest.
            used.sort()
            widths = np.array([n for n, _ in used])
            places = np.repeat(np.arange(len(used)), 1 << (self.bits - widths))
            order = reversed_bits(self.bits)
            self.symbols, self.widths = np.empty(1 << self.bits, np.uint16), np.empty(1 << self.bits, np.uint8)
            self.symbols[order] = np.array([s for _, s in used])[places]
            self.widths[order] = widths[places]
            self.table: list[tuple[int, int]] | None = None

    def pairs(self) -> list[tuple[int, int]]:
        """The table as (symbol, width) pairs."""
        if self.table is None:
            self.table = list(zip(self.symbols.tolist(), self.widths.tolist(), strict=True))
        return self.table

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.pairs()[bits.peek(self.bits)]
        bits.take(n)
        return symbol


@functools.lru_cache(512)
def _prefix_code(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(lengths)


def _read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[PrefixCode]:
    """A group of prefix codes. A code written like the one before it isn't read again."""
    codes: list[PrefixCode] = []
    for i, size in enumerate(sizes):
        start = bits.at
        if i > 1 and size == sizes[i - 1] and length <= bits.end - start and bits.span(start, length) == bits.span(start - length, length):
            codes.append(codes[-1])
            bits.at += length
        else:
            codes.append(_read_code(bits, size))
        length = bits.at - start
    return codes


def _read_code(bits: Bits, size: int) -> PrefixCode:
    lengths = [0] * size
    if bits.take(1):  # simple: one or two symbols
        two = bits.take(1)
        first = bits.take(8 if bits.take(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.take(8)] = 1
        return _prefix_code(tuple(lengths))
    of_lengths = [0] * len(CODE_LENGTH_ORDER)
    for i in range(4 + bits.take(4)):
        of_lengths[CODE_LENGTH_ORDER[i]] = bits.take(3)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    code, at, previous = _prefix_code(tuple(of_lengths)), 0, 8
    if code.only is not None:
        table, mask = [(code.only, 0)], 0
    else:
        table, mask = code.pairs(), (1 << code.bits) - 1
    # A length takes 14 bits at most: 7 of its code, 7 of a run.
    window, used = bits.span(bits.at, min(14 * size, bits.end - bits.at)), 0
    while at < size and left:
        left -= 1
        symbol, n = table[window & mask]
        window >>= n
        used += n
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            previous = symbol or previous
        else:
            n, least = ((2, 3), (3, 3), (7, 11))[symbol - 16]
            times = least + (window & ((1 << n) - 1))
            window >>= n
            used += n
            if symbol == 16:
                lengths[at : at + times] = [previous] * times
            at += times
    bits.at += used
    if bits.at > bits.end:
        raise ValueError("the picture ends early")
    if at > size:
        raise ValueError("too many code lengths")
    return _prefix_code(tuple(lengths))


def _long_value(bits: Bits, symbol: int) -> int:
    """Length or distance of a prefix symbol and its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def _bulk(bits: Bits, codes: list[PrefixCode], count: int) -> np.ndarray | None:
    """All pixels at once, if every channel has one symbol or codes of one length and no symbol stands for anything but a byte."""
    if any(c.only is None and not c.fixed for c in codes[:4]) or any(codes[0].lengths[256:]):
        return None
    widths = [0 if c.only is not None else c.bits for c in codes[:4]]
    pixel = sum(widths)
    stream = np.frombuffer(bits.data, np.uint8)
    if bits.at + count * pixel > bits.end:
        raise ValueError("the picture ends early")
    channels = []
    if pixel and widths[0] * 4 == pixel and widths.count(widths[0]) == 4:
        # One width w for all four: eight codes are w bytes.
        w, n = widths[0], count * 4
        groups = -(-n // 8)
        own, skip = stream[bits.at >> 3 :][: groups * w + 1].astype(np.uint16), bits.at & 7
        part = np.zeros(groups * w + 1, np.uint16)
        part[: len(own)] = own
        part = (part[:-1] >> skip | part[1:] << (8 - skip)).astype(np.uint8)
        whole = np.zeros((groups, 8), np.uint8)
        whole[:, :w] = part.reshape(groups, w)
        fields = (whole.view("<u8") >> (np.arange(8, dtype=np.uint64) * np.uint64(w))).astype(np.uint8) & np.uint8((1 << w) - 1)
        fields = fields.reshape(-1)[:n].reshape(count, 4)
        if all(c is codes[0] or (c.symbols == codes[0].symbols).all() for c in codes[1:4]):
            bits.at += count * pixel
            return codes[0].symbols.astype(np.uint8)[fields][:, (2, 0, 1, 3)].copy().view("<u4").reshape(count)
        channels = [c.symbols.astype(np.uint8)[fields[:, i]] for i, c in enumerate(codes[:4])]
    else:
        starts = bits.at + np.arange(count, dtype=np.int64) * pixel
        padded = np.concatenate([stream, np.zeros(8, np.uint8)]).astype(np.uint32)
        for c, w in zip(codes, widths, strict=False):
            if not w:
                channels.append(np.full(count, c.only, np.uint8))
                continue
            byte = starts >> 3
            value = (padded[byte] | padded[byte + 1] << np.uint32(8) | padded[byte + 2] << np.uint32(16)) >> (starts & 7).astype(np.uint32)
            channels.append(c.symbols.astype(np.uint8)[value & np.uint32((1 << w) - 1)])
            starts = starts + w
    bits.at += count * pixel
    green, red, blue, alpha = channels
    out = np.empty((count, 4), np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = blue, green, red, alpha
    return out.view("<u4").reshape(count)


def _look(code: PrefixCode, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and width of the code at the low end of each window."""
    if code.only is not None:
        return np.full(len(window), code.only, np.uint16), np.zeros(len(window), np.uint8)
    at = (window & np.uint64((1 << code.bits) - 1)).view(np.int64)
    return code.symbols.take(at), code.widths.take(at)


def _walk(after: np.ndarray) -> np.ndarray:
    """The places 0, after[0], after[after[0]], ... below len(after): every eighth one by one, those between at once."""
    n = len(after)
    step = np.append(np.minimum(after, n), n)
    far = step
    for _ in range(3):
        far = far[far]
    found, at, jump = [], 0, memoryview(far)
    while at < n:
        found.append(at)
        at = jump[at]
    places = [np.array(found)]
    for _ in range(7):
        places.append(step[places[-1]])
    tokens = np.stack(places, 1).reshape(-1)
    return tokens[tokens < n]


def _long_values(symbols: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of prefix symbols, their extra bits at the low end of the windows, and the number of those."""
    symbols = symbols.astype(np.int64)
    extra = np.maximum(0, (symbols - 2) >> 1)
    more = (window & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return np.where(symbols < 4, symbols + 1, ((2 + (symbols & 1)) << extra) + more + 1), extra


def _bulk_tokens(bits: Bits, codes: list[PrefixCode], count: int, width: int) -> np.ndarray | None:
    """All pixels of a picture with one group of codes and no cache; None where a token may not fit a window."""
    green, red, blue, alpha, far = codes
    if max(green.bits + red.bits + blue.bits + alpha.bits, green.bits + 10 + far.bits + 18) > 57 or green.only is not None and not (red.bits or blue.bits or alpha.bits):
        return None
    stream = np.concatenate([np.frombuffer(bits.data, np.uint8), np.zeros(16, np.uint8)])
    values, lengths, backs, held = [], [], [], 0
    most = max(green.bits + red.bits + blue.bits + alpha.bits, 57 if any(green.lengths[256:]) else 0)
    while held < count:
        if bits.at >= bits.end:
            raise ValueError("the picture ends early")
        first, n = bits.at >> 3, min(CHUNK, bits.end - bits.at, (count - held) * most)
        part = stream[first : first + (n + 7 >> 3) + 9]
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, 8)).view("<u8").reshape(-1)
        window = (words[: -(-(n + 7) // 8), None] >> np.arange(8, dtype=np.uint64)).reshape(-1)[bits.at & 7 :][:n]
        symbol, used = _look(green, window)
        size = used.astype(np.int64)
        for code in (red, blue, alpha):
            if code.only is None:
                size += _look(code, window >> size.view(np.uint64))[1]
        back = np.flatnonzero(symbol >= 256)
        if len(back):
            rest = window[back] >> used[back].astype(np.uint64)
            extra = np.maximum(0, (symbol[back].astype(np.int64) - 258) >> 1)
            kind, wide = _look(far, rest >> extra.view(np.uint64))
            size[back] = used[back] + extra + wide + np.maximum(0, (kind.astype(np.int64) - 2) >> 1)
        after = np.arange(n) + size
        tokens = _walk(after)
        at, own = int(after[tokens[-1]]), symbol[tokens].astype(np.int64)
        is_back = own >= 256
        length, distance, value = np.ones(len(tokens), np.int64), np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.uint32)
        if is_back.any():
            rest = window[tokens[is_back]] >> used[tokens[is_back]].astype(np.uint64)
            length[is_back], extra = _long_values(own[is_back] - 256, rest)
            rest >>= extra.astype(np.uint64)
            kind, wide = _look(far, rest)
            distance[is_back] = _long_values(kind, rest >> wide.astype(np.uint64))[0]
        rest, channels = window[tokens] >> used[tokens].astype(np.uint64), []
        for code in (red, blue, alpha):
            seen, wide = _look(code, rest)
            channels.append(seen.astype(np.uint32))
            rest = rest >> wide.astype(np.uint64)
        value = channels[2] << np.uint32(24) | channels[0] << np.uint32(16) | (own & 255).astype(np.uint32) << np.uint32(8) | channels[1]
        ends = held + np.cumsum(length)
        last = int(np.searchsorted(ends, count))
        if last < len(tokens):  # what follows the picture isn't its
            at, tokens, ends = int(after[tokens[last]]), tokens[: last + 1], ends[: last + 1]
        if bits.at + at > bits.end:
            raise ValueError("the picture ends early")
        values.append(value[: len(tokens)])
        lengths.append(length[: len(tokens)])
        backs.append(distance[: len(tokens)])
        held = int(ends[-1])
        bits.at += at
    value, length, code = np.concatenate(values), np.concatenate(lengths), np.concatenate(backs)
    starts = np.cumsum(length) - length
    pixels, source = np.zeros(count, np.uint32), np.arange(count)
    copies = np.flatnonzero(code)
    pixels[starts[code == 0]] = value[code == 0]
    if len(copies):
        near = np.array([max(1, x + y * width) for x, y in DISTANCES])
        back = np.where(code[copies] > len(DISTANCES), code[copies] - len(DISTANCES), near[np.minimum(code[copies], len(DISTANCES)) - 1])
        if held > count or (back > starts[copies]).any():
            raise ValueError("a back-reference leaves the picture")
        n = length[copies]
        place = np.repeat(starts[copies] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        source[place] -= np.repeat(back, n)
        while True:  # a copy of a copy, until all come from a literal
            before = source[source]
            if (before == source).all():
                break
            source = before
    return pixels[source]


def _read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Pixels 0xAARRGGBB of an entropy-coded image."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_of, shift, groups = None, 0, 1
    if top and bits.take(1):
        shift = 2 + bits.take(3)
        wide, high = (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
        group_of = ((_read_pixels(bits, wide, high, False) >> np.uint32(8)) & np.uint32(0xFFFF)).reshape(high, wide)
        groups = int(group_of.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [_read_codes(bits, sizes) for _ in range(groups)]
    count = width * height
    if groups == 1 and not cache_bits:
        found = _bulk(bits, codes[0], count)
        if found is None and count > 16:
            found = _bulk_tokens(bits, codes[0], count, width)
        if found is not None:
            return found
    pixels, cache, at, own = [0] * count, [0] * (1 << cache_bits), 0, codes[0]
    spread = 32 - cache_bits
    while at < count:
        if group_of is not None:
            own = codes[group_of[(at // width) >> shift, (at % width) >> shift]]
        symbol = own[0].read(bits)
        first = at
        if symbol < 256:
            red, blue, alpha = (own[i].read(bits) for i in (1, 2, 3))
            pixels[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < 280:
            length = _long_value(bits, symbol - 256)
            code = _long_value(bits, own[4].read(bits))
            if code > len(DISTANCES):
                back = code - len(DISTANCES)
            else:
                x, y = DISTANCES[code - 1]
                back = max(1, x + y * width)
            if back > at or at + length > count:
                raise ValueError("a back-reference leaves the picture")
            for _ in range(length):
                pixels[at] = pixels[at - back]
                at += 1
        else:
            pixels[at] = cache[symbol - 280]
            at += 1
        if cache_bits:
            for p in pixels[first:at]:
                cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> spread] = p
    return np.array(pixels, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(alpha, red, green, blue) as the last axis, as signed ints."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _pixels(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The format's fourteen predictors, on (alpha, red, green, blue)."""
    half = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0], np.int32)
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return half(half(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return half(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        # The neighbour nearer to left + top - top_left, by the sum over channels.
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = half(left, top)
    # Halving rounds towards zero.
    return np.clip(mean + np.trunc((mean - top_left) / 2).astype(np.int32), 0, 255)


def invert_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Adds each pixel's prediction; ``modes``: the predictor of each block of 2**bits pixels a side."""
    out = _channels(pixels)
    height, width = pixels.shape
    kinds = ((modes >> np.uint32(8)) & np.uint32(15)).astype(int)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = np.array([255, 0, 0, 0], np.int32) if x == 0 else out[y, x - 1]
            elif x == 0:
                guess = out[y - 1, x]
            else:
                # Right of the last column comes the first pixel of the same row.
                corner = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                guess = predict(kinds[y >> bits, x >> bits], out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], corner)
            out[y, x] = (out[y, x] + guess) & 255
    return _pixels(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def invert_cross_colour(pixels: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    """Adds what red and blue owe to green and red, by the block's three signed factors (5 fraction bits)."""
    height, width = pixels.shape
    c, f = _channels(pixels), _channels(factors)[np.arange(height)[:, None] >> bits, np.arange(width) >> bits]
    green = _signed(c[..., 2])
    red = (c[..., 1] + (_signed(f[..., 3]) * green >> 5)) & 255
    blue = c[..., 3] + (_signed(f[..., 2]) * green >> 5) + (_signed(f[..., 1]) * _signed(red) >> 5)
    c[..., 1], c[..., 3] = red, blue
    return _pixels(c)


def add_green(pixels: np.ndarray) -> np.ndarray:
    c = _channels(pixels)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return _pixels(c)


def invert_palette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Looks up the palette; palettes of up to 16 colours hold several pixels in one green value."""
    n = len(palette)
    bits = 8 if n > 16 else 4 if n > 4 else 2 if n > 2 else 1
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    per = 8 // bits
    index = (green[..., None] >> (np.arange(per, dtype=np.uint32) * np.uint32(bits))) & np.uint32((1 << bits) - 1)
    index = index.reshape(len(pixels), -1)[:, :width]
    full = np.zeros(256, np.uint32)  # colours beyond the palette are transparent black
    full[:n] = palette
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) as 0xAARRGGBB of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        at += 8 + (n := int.from_bytes(data[at + 4 : at + 8], "little")) + n % 2
        if at + 8 > len(data):
            raise ValueError("no lossless picture in the file")
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.take(8) != 0x2F:
        raise ValueError("not a lossless picture")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    transforms, wide = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = bits.take(3) + 2
            shape = (height + (1 << b) - 1) >> b, (wide + (1 << b) - 1) >> b
            transforms.append((kind, _read_pixels(bits, shape[1], shape[0], False).reshape(shape), b))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, None, 0))
        else:
            n = bits.take(8) + 1
            steps = _channels(_read_pixels(bits, n, 1, False))
            transforms.append((kind, _pixels(np.cumsum(steps, 0)), wide))
            per = 1 if n > 16 else 2 if n > 4 else 4 if n > 2 else 8
            wide = -(-wide // per)
    pixels = _read_pixels(bits, wide, height, True).reshape(height, wide)
    for kind, values, b in reversed(transforms):
        if kind == PREDICTOR:
            pixels = invert_predictor(pixels, values, b)
        elif kind == CROSS_COLOUR:
            pixels = invert_cross_colour(pixels, values, b)
        elif kind == SUBTRACT_GREEN:
            pixels = add_green(pixels)
        else:
            pixels = invert_palette(pixels, values, b)
    return pixels


class BitWriter:
    """Writes little-endian bit fields."""

    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def one_symbol(self, symbol: int) -> None:
        """A simple prefix code of a single symbol."""
        self.put(0b101, 3)
        self.put(symbol, 8)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a best prefix code of at most WIDEST bits for the symbols with a count."""
    used, out = np.flatnonzero(counts), np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, node = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            (w, i), (v, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = node
            heapq.heappush(heap, (w + v, node))
            node += 1
        depth = [0] * node
        for i in range(node - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= WIDEST:
            out[used] = depth[: len(used)]
            return out
        weights = [(w + 1) // 2 for w in weights]  # flatter, and so shorter


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of canonical lengths, first bit lowest."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return codes
    order = used[np.argsort(lengths[used], kind="stable")]
    steps = 1 << (WIDEST - lengths[order])
    top = np.cumsum(steps) - steps
    codes[order] = reversed_bits(WIDEST)[top] & ((1 << lengths[order]) - 1)
    return codes


@functools.cache
def _length_codes() -> dict[int, tuple[int, int]]:
    """(code, width) of each code length symbol."""
    lengths = np.zeros(19, np.int64)
    for symbol, n in LENGTH_CODE.items():
        lengths[symbol] = n
    return {symbol: (int(c), LENGTH_CODE[symbol]) for symbol, c in enumerate(canonical(lengths)) if symbol in LENGTH_CODE}


def put_code(out: BitWriter, lengths: np.ndarray) -> None:
    """Writes a prefix code: a single symbol (or none) as a simple code, more by their lengths."""
    used = np.flatnonzero(lengths)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        out.one_symbol(int(used[0]) if len(used) else 0)
        return
    codes = _length_codes()
    out.put(0, 1)
    out.put(len(CODE_LENGTH_ORDER) - 4, 4)
    for s in CODE_LENGTH_ORDER:
        out.put(LENGTH_CODE.get(s, 0), 3)
    out.put(0, 1)
    at, value, size, widths = 0, 0, 0, lengths.tolist()
    for s in [*used.tolist(), len(lengths)]:
        while s - at >= 3:
            run = min(s - at, 138)
            code, n = codes[17 if run < 11 else 18]
            value |= (code | (run - (3 if run < 11 else 11)) << n) << size
            size += n + (3 if run < 11 else 7)
            at += run
        for _ in range(s - at):
            value |= codes[0][0] << size
            size += codes[0][1]
        if s < len(lengths):
            code, n = codes[widths[s]]
            value |= code << size
            size += n
        at = s + 1
    out.put(value, size)


def prefix_symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and their value, of lengths or distance codes."""
    if not len(values):
        return values, values, values
    v = values - 1
    high = np.maximum(1, np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1)
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + ((v >> np.maximum(0, high - 1)) & 1)), extra, np.where(v < 4, 0, v & ((1 << extra) - 1))


def repeats(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Starts, lengths and distances of back-references: at each place the latest repeat of MATCH pixels, as long as it goes on, first come first served."""
    if len(x) <= MATCH:
        return [], [], []
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, MATCH)).view("<u8").reshape(-1)
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    back = np.zeros(len(keys), np.int64)
    back[order[1:][same]] = order[1:][same] - order[:-1][same]
    back[back > (1 << 20) - len(DISTANCES)] = 0
    places = np.flatnonzero(back)
    if not len(places):
        return [], [], []
    # A repeat lasts while the distance stays the same from place to place.
    ends = np.flatnonzero(np.concatenate([back[1:] != back[:-1], [True]]))
    lasts = ends[np.searchsorted(ends, places)]
    lengths, places_list, distances = np.minimum(lasts - places + MATCH, LONGEST).tolist(), places.tolist(), back[places].tolist()
    out, at, k = ([], [], []), 0, 0
    while (k := bisect_left(places_list, at, k)) < len(places_list):
        at = places_list[k]
        out[0].append(at)
        out[1].append(lengths[k])
        out[2].append(distances[k])
        at += lengths[k]
    return out


def put_tokens(out: BitWriter, x: np.ndarray) -> bytes:
    """Codes and tokens of a one-channel picture, after what ``out`` holds; returns all bytes."""
    starts, lengths, backs = (np.array(r, np.int64) for r in repeats(x))
    alone = np.ones(len(x), bool)
    if len(starts):
        cover = np.zeros(len(x) + 1, np.int64)
        cover[starts] += 1
        cover[starts + lengths] -= 1
        alone = np.cumsum(cover)[:-1] == 0
    literals = np.flatnonzero(alone)
    ls, le, lv = prefix_symbols(lengths)
    ds, de, dv = prefix_symbols(backs + len(DISTANCES))
    of_green = code_lengths(np.bincount(x[literals], minlength=280) + (np.bincount(ls + 256, minlength=280) if len(ls) else 0))
    of_far = code_lengths(np.bincount(ds, minlength=40))
    put_code(out, of_green)
    for _ in range(3):
        out.one_symbol(0)
    put_code(out, of_far)
    green, far = canonical(of_green), canonical(of_far)
    wide_green, wide_far = (np.where(np.count_nonzero(n) < 2, 0, n) for n in (of_green, of_far))
    u = lambda a: a.astype(np.uint64)
    n = wide_green[ls + 256] if len(ls) else ls
    value = green[ls + 256] | u(lv) << u(n)
    n = n + le
    value |= far[ds] << u(n)
    n = n + wide_far[ds]
    value |= u(dv) << u(n)
    places = np.concatenate([literals, starts])
    order = np.argsort(places, kind="stable")
    values, sizes = np.concatenate([green[x[literals]], value])[order], np.concatenate([wide_green[x[literals]], n + de])[order]
    offsets = out.at + np.cumsum(sizes) - sizes
    total = out.at + int(sizes.sum())
    words = np.zeros((total >> 6) + 2, np.uint64)
    head = out.value.to_bytes(-(-out.at // 64) * 8, "little")
    words[: len(head) // 8] = np.frombuffer(head, "<u8")
    word, shift = offsets >> 6, u(offsets & 63)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] |= np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero((shift > 0) & (offsets + sizes > (word + 1) << 6))  # one a word at most
    words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return words.tobytes()[: -(-total // 8)]


def riff(stream: bytes) -> bytes:
    body = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


def encode(samples: np.ndarray, width: int) -> bytes:
    """A lossless WebP file of bytes, one to a pixel (its green), ``width`` pixels a row."""
    height = len(samples) // width
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    colours = np.flatnonzero(np.bincount(samples, minlength=256))
    n = len(colours)
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(n - 1, 8)
    # The palette is a picture of steps from colour to colour, in codes of one length: those used, and the lowest others to fill it.
    steps = np.concatenate([colours[:1], colours[1:] - colours[:-1]])
    lengths, w = np.zeros(280, np.int64), int(len(own := np.unique(steps)) - 1).bit_length()
    lengths[own] = max(1, w)
    lengths[np.flatnonzero(lengths == 0)[: (1 << w) - len(own)]] = w
    codes = canonical(lengths)
    out.put(0, 1)  # no colour cache
    put_code(out, lengths)
    for _ in range(4):
        out.one_symbol(0)
    if np.count_nonzero(lengths) > 1:
        for code in codes[steps].tolist():
            out.put(code, w)
    index = np.zeros(256, np.uint8)
    index[colours] = np.arange(n)
    x = index[samples].reshape(height, width)
    bits = 8 if n > 16 else 4 if n > 4 else 2 if n > 2 else 1
    if bits < 8:
        per = 8 // bits
        padded = np.zeros((height, -(-width // per) * per), np.uint8)
        padded[:, :width] = x
        x = np.bitwise_or.reduce(padded.reshape(height, -1, per) << (np.arange(per, dtype=np.uint8) * np.uint8(bits)), 2)
    out.put(0, 1 + 1 + 1)  # no more transforms, no colour cache, no meta codes
    return riff(put_tokens(out, x.reshape(-1)))


def pack(text: str | None) -> tuple[bytes, int, int]:
    """The picture of a text, the text's bytes and the bytes stored."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
    width = 64 * -(-len(padded) // (64 * MAX_SIDE))
    full = padded + b"\0" * (-len(padded) % width)
    return encode(np.frombuffer(full, np.uint8), width), len(raw), len(padded)


def unpack(media: bytes, payload_bytes: int) -> bytes:
    """The stored bytes of a picture."""
    return ((decode(media).reshape(-1) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes()[:payload_bytes]


def features(payload: bytes) -> str:
    """Mean and deviation (in thousandths), number of values, and a 64-bit hash: which of 64 equal parts are above the mean."""
    x = np.frombuffer(payload, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    squares = int((np.bincount(x, minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    parts = x.reshape(64, -1).sum(1, dtype=np.int64) * 64 > total
    variance = max(0, n * squares - total * total) // (n * n)
    return f"mean={total * 1000 // n};var={variance};values={len(np.flatnonzero(np.bincount(x)))};hash={int(np.packbits(parts).tobytes().hex(), 16):016x}"


MEDIA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
READ = T.StructType([T.StructField(*x) for x in (("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))])


def _stored(texts: list) -> list:
    rows = [pack(t) for t in texts]
    return [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary())]


def _seen(media: list, sizes: list) -> list:
    rows = []
    for m, n in zip(media, sizes, strict=True):
        payload = unpack(m, n)
        rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(payload)))
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]


def _map(df: DataFrame, added: T.StructType, make, gone: tuple[str, ...] = ()) -> DataFrame:
    kept = [c for c in df.columns if c not in added.names and c not in gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what is held besides the batch
                part = batch.slice(at, 512)
                column = lambda c, part=part: part.column(part.schema.get_field_index(c))
                yield pa.RecordBatch.from_arrays([*map(column, kept), *make(column)], [*kept, *added.names])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *added.fields]))


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``media`` (the WebP file), ``n_bytes`` and ``payload_bytes``."""
    return _map(docs, MEDIA, lambda column: _stored(column(text).to_pylist()))


def read_media(media: DataFrame) -> DataFrame:
    """Decodes ``media`` and adds digests and features of what it holds."""
    return _map(media, READ, lambda column: _seen(column("media").to_pylist(), column("payload_bytes").to_pylist()))


def store_and_read(docs: DataFrame, text: str = "text") -> DataFrame:
    """``store_texts`` and ``read_media`` in one step, without moving the files between them."""

    def make(column) -> list:
        made = _stored(column(text).to_pylist())
        return [*made[:2], *_seen(made[2].to_pylist(), made[1].to_pylist())]

    return _map(docs, T.StructType([*MEDIA.fields[:2], *READ.fields]), make)


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = store_and_read(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op10_webp": op10_webp}
ORACLES: dict[str, str] = {}
