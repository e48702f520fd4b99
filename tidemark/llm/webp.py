"""Lossless WebP (VP8L) reading and writing, and the query that keeps documents as such images.

The reader handles the whole lossless format: canonical prefix codes (simple and coded lengths), meta prefix
images, back-references with the 2-D distance map, the colour cache, and the predictor, cross-colour,
subtract-green and palette transforms. Pixels are ARGB, four payload bytes each. numpy gives the 16 bits from each bit of
the stream on, and how many bits a symbol there would have; one short step a symbol then finds where the symbols are
(`find_symbols`), and those of many images are told at once (`tell`): copies and cache hits point to pixels before them.
The writer finds back-references and colour-cache hits by sorting, and writes them and literals with prefix codes made
from their counts, or with stock codes where those save too little; of the transforms it uses none, as on bytes of text
none pays. It makes the files of many payloads in the same steps.

Defined results of `store_documents`: null or empty text is a payload of 64 zero bytes; a payload of over 1 MiB
becomes several images one after another; equal texts give equal media; repeated rows are stored each; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, steps, table, utf8

ROW = 64  # bytes: a row of 16 ARGB pixels
MAX_ROWS = 16384
# Fixed values of the format.
LENGTH_CODE_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
_NEAR = np.array(NEAR)
#: Pixels of a match, at least (a match shorter than this costs as much as its literals) and at most (the format's limit).
LEAST_COPY, MOST_COPY = 3, 4096
#: Longest prefix code the writer makes for pixels; the format allows 15 bits, shorter codes have smaller tables.
LONGEST = 13
CACHE_BITS = 8
#: Bits that codes of an image's own have to save against the stock codes to be worth their making.
LEAST_SAVED = 16_000
REVERSED = [int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)]
_BACKWARDS = np.array(REVERSED)
#: Stream bytes that the reader tells at a time, pixels that reader or writer take, and images that the writer takes; a larger image is
#: taken alone.
READ_BYTES, READ_PIXELS, MOST_IMAGES = 2 << 20, 1 << 19, 1024


class Bits:
    """Reads a stretch of a byte string from the lowest bit of each byte on; stretches of one string share its `windows`."""

    def __init__(self, data: bytes, start: int = 0, stop: int | None = None, windows: array | None = None):
        self.data, self.at, self.end = data, 8 * start, 8 * (len(data) if stop is None else stop)
        self.windows = bit_windows(data) if windows is None else windows

    def peek(self, n: int) -> int:
        start = self.at >> 3
        return int.from_bytes(self.data[start : start + max(8, n + 15 >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the image ends early")
        value = self.peek(n)
        self.at += n
        return value


def bit_windows(data: bytes) -> array:
    """The 16 bits from each bit on, zeros beyond the end."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(12, np.uint8)]).astype(np.uint32)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    found = np.empty((len(wide), 8), np.uint16)
    for k in range(8):
        found[:, k] = wide >> np.uint32(k)
    out = array("H")
    out.frombytes(found.reshape(-1).view(np.uint8))
    return out


class Prefix:
    """A canonical prefix code. `table` gives symbol << 4 | bits for the next `mask` bits; a lone symbol has no bits."""

    def __init__(self, lengths: Sequence[int]):
        self.codes = canonical(lengths)
        width = max(n for _, n in self.codes.values())
        self.mask = (1 << width) - 1
        # In the codes' order each takes a run of the table; bits are read in reverse.
        told, sizes = zip(*((s << 4 | n, 1 << width - n) for s, (_, n) in self.codes.items()), strict=True)
        self.table = np.repeat(np.array(told, np.uint16), sizes)[_BACKWARDS[: 1 << width] >> 15 - width]

    @functools.cached_property
    def entries(self) -> array:
        return array("H", self.table.tobytes())

    @functools.cached_property
    def lengths(self) -> np.ndarray:
        return (self.table & 15).astype(np.uint8)

    @functools.cached_property
    def bits(self) -> bytes:
        """The symbol's bits alone."""
        return self.lengths.tobytes()

    @functools.cached_property
    def far(self) -> bytes:
        """The bits of a distance: its symbol's and the extra ones."""
        return ((self.table & 15) + extra_bits(self.table >> 4)).astype(np.uint8).tobytes()


def extra_bits(symbol: np.ndarray) -> np.ndarray:
    """How many bits follow the prefix symbol of a length or distance."""
    return np.maximum(symbol.astype(np.int64) - 2, 0) >> 1


def canonical(lengths: Sequence[int]) -> dict[int, tuple[int, int]]:
    """Each symbol's bits, as they are read, and their number."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if not used:
        raise ValueError("a prefix code without symbols")
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    if sum(1 << 15 - n for n, _ in used) != 1 << 15:
        raise ValueError("an incomplete prefix code")
    codes, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        last = n
        codes[s] = (REVERSED[code] >> 15 - n, n)
        code += 1
    return codes


#: Alphabets of one image mostly share their codes, so equal lengths are not laid out again.
_prefix = functools.lru_cache(64)(Prefix)


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = [first, bits.read(8)] if two else [first]
        for s in symbols:
            if s >= alphabet:
                raise ValueError("a symbol outside the alphabet")
            lengths[s] = 1
        return _prefix(tuple(lengths))
    outer = [0] * 19
    for k in range(4 + bits.read(4)):
        outer[LENGTH_CODE_ORDER[k]] = bits.read(3)
    code = _prefix(tuple(outer))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    s, before = 0, 8
    windows, p, table, mask = bits.windows, bits.at, code.entries, code.mask
    try:
        while s < alphabet and left:
            left -= 1
            n = table[windows[p] & mask]
            p += n & 15
            n >>= 4
            if n < 16:
                lengths[s] = n
                before = n or before
                s += 1
                continue
            base, extra = ((3, 2), (3, 3), (11, 7))[n - 16]
            times = base + (windows[p] & (1 << extra) - 1)
            p += extra
            if s + times > alphabet:
                raise ValueError("code lengths beyond the alphabet")
            if n == 16:
                lengths[s : s + times] = [before] * times
            s += times
    except IndexError:
        raise ValueError("the image ends early") from None
    bits.at = p
    return _prefix(tuple(lengths))


#: Groups of codes read lately: how many bits they took, those bits, and what they said. Equal bits say the same again.
_read_lately: dict[tuple[int, ...], list[tuple[int, int, list]]] = {}


def read_group(bits: Bits, sizes: tuple[int, ...]) -> list[Prefix]:
    """The green, red, blue, alpha and distance codes."""
    lately = _read_lately.setdefault(sizes, [])
    for n, value, codes in lately:
        if bits.at + n <= bits.end and bits.peek(n) == value:
            bits.at += n
            return codes
    start = bits.at
    codes = [read_prefix(bits, n) for n in sizes]
    n, bits.at = bits.at - start, start
    lately.insert(0, (n, bits.peek(n), codes))
    del lately[2:]
    bits.at += n
    return codes


#: A symbol has fewer bits. What `leaps` says where only the codes tell how many.
MOST_BITS, LOOK = 64, 255
#: Bits that `leaps` works on at a time.
LEAP_BITS = 1 << 16


def leaps(window: np.ndarray, codes: list[Prefix]) -> bytes:
    """From each bit but the last MOST_BITS on, the bits of a literal or cache hit that would start there; LOOK for a back-reference."""
    green, *others, _ = codes
    out = []
    for k in range(0, len(window) - MOST_BITS, LEAP_BITS):
        part = window[k : k + LEAP_BITS + MOST_BITS]
        told = green.table.take(part[:-MOST_BITS] & green.mask)
        here = np.arange(len(part))
        after = {id(c): here + c.lengths.take(part & c.mask) for c in others}
        size = (told & 15).astype(np.uint8)
        at = here[:-MOST_BITS] + size
        for c in others:
            at = after[id(c)].take(at, mode="clip")
        at -= here[:-MOST_BITS]
        size = np.where(told < 256 << 4, at.astype(np.uint8), size)
        size |= ((told >= 256 << 4) & (told < 280 << 4)).view(np.uint8) * np.uint8(LOOK)
        out.append(size.tobytes())
    return b"".join(out)


def _long(windows: array, at: int, symbol: int) -> tuple[int, int]:
    """A length from its prefix symbol and the extra bits at `at`; where these end."""
    if symbol < 4:
        return symbol + 1, at
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + (windows[at] & (1 << extra) - 1) + 1, at + extra


class Symbols(NamedTuple):
    """The bits of each symbol of an image from `start` on, and with which of its groups of codes it is told (None: the first)."""

    width: int
    total: int
    cache_bits: int
    groups: list[list[Prefix]]
    start: int
    sizes: bytearray
    chosen: array | None


def find_symbols(bits: Bits, width: int, height: int, main: bool) -> Symbols:
    """One short step a symbol: where it starts depends on all before it, but not on what they are."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    groups, tile, meta = 1, 0, None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width // (1 << tile))
        meta = (read_pixels(bits, across, -(-height // (1 << tile)), False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [read_group(bits, sizes) for _ in range(groups)]
    total, at, k, sizes, chosen = width * height, 0, 0, bytearray(), array("H")
    windows, start, p, mark = bits.windows, bits.at, bits.at, sizes.append
    stop = min(bits.end, start + MOST_BITS * total)
    # A symbol of no bits may stand at the end.
    leap = bytes([LOOK]) * (stop + 1 - start) if meta else leaps(np.frombuffer(windows, np.uint16)[start : stop + 1 + MOST_BITS], codes[0])
    try:
        while True:
            p, at = p - start, at - len(sizes)
            for _ in repeat(None, total - at - len(sizes)):
                n = leap[p]
                if n == LOOK:
                    break
                mark(n)
                p += n
            p, at = p + start, at + len(sizes)
            if at >= total:
                break
            if meta:
                k = meta[(at // width >> tile) * across + (at % width >> tile)]
                chosen.append(k)
            green, red, blue, alpha, distance = codes[k]
            before = p
            s = green.entries[windows[p] & green.mask]
            p += s & 15
            s >>= 4
            if s < 256:
                p += red.bits[windows[p] & red.mask]
                p += blue.bits[windows[p] & blue.mask]
                p += alpha.bits[windows[p] & alpha.mask]
                at += 1
            elif s < 280:
                n, p = _long(windows, p, s - 256)
                at += n
                p += distance.far[windows[p] & distance.mask]
            else:
                at += 1
            mark(p - before)
    except IndexError:
        raise ValueError("the image ends early") from None
    if p > bits.end:
        raise ValueError("the image ends early")
    if at > total:
        raise ValueError("a back-reference outside the image")
    bits.at = p
    return Symbols(width, total, cache_bits, codes, start, sizes, chosen if meta else None)


def _followed(source: np.ndarray, places: np.ndarray) -> None:
    """Lets the pixels at `places` point to where their chains of sources end."""
    while len(places):
        near = source[places]
        far = source[near]
        places = places[far != near]
        source[places] = far[far != near]


def tell(windows: array, found: Sequence[Symbols]) -> np.ndarray:
    """ARGB values of the images, row after row, one image after another, before inverse transforms."""
    window = np.frombuffer(windows, np.uint16)
    sizes = [np.frombuffer(x.sizes, np.uint8) for x in found]
    p = np.concatenate([x.start + np.cumsum(n) - n for x, n in zip(found, sizes, strict=True)], dtype=np.int64)
    image = np.repeat(np.arange(len(found)), [len(n) for n in sizes])
    totals = np.array([x.total for x in found])
    groups = {id(g): g for x in found for g in x.groups}
    number = {k: n for n, k in enumerate(groups)}
    told_by = [np.array([number[id(g)] for g in x.groups]) for x in found]
    group = np.concatenate([np.repeat(k[:1], len(x.sizes)) if x.chosen is None else k[np.frombuffer(x.chosen, np.uint16)] for x, k in zip(found, told_by, strict=True)])
    tables = []
    for codes in zip(*groups.values(), strict=True):
        at = np.cumsum([0, *(len(c.table) for c in codes)])[:-1]
        tables.append((np.concatenate([c.table for c in codes]), at, np.array([c.mask for c in codes])))

    def look(k: int, p: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at p of the group's k-th code, and where they end."""
        table, at, mask = tables[k]
        told = table[at[group] + (window[p] & mask[group])]
        return told >> 4, p + (told & 15)

    def long(p: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths or distances from their prefix symbols and the extra bits at p, and where they end."""
        symbol, extra = symbol.astype(np.int64), extra_bits(symbol)
        more = (window[p] | window[p + 16].astype(np.int64) << 16) & (1 << extra) - 1
        return np.where(symbol < 4, symbol, (2 + (symbol & 1) << extra) + more) + 1, p + extra

    symbol, p = look(0, p, group)
    literal, copy, hit = np.flatnonzero(symbol < 256), np.flatnonzero((symbol >= 256) & (symbol < 280)), np.flatnonzero(symbol >= 280)
    size = np.ones(len(symbol), np.int64)
    size[copy], q = long(p[copy], symbol[copy] - 256)
    place = np.cumsum(size) - size
    first = np.cumsum(totals) - totals
    argb, source = np.zeros(totals.sum(), np.uint32), np.arange(totals.sum())

    g, value, q_literal = group[literal], symbol[literal].astype(np.uint32) << 8, p[literal]
    for k, shift in ((1, 16), (2, 0), (3, 24)):
        s, q_literal = look(k, q_literal, g)
        value |= s.astype(np.uint32) << shift
    argb[place[literal]] = value

    s, q = look(4, q, group[copy])
    back, _ = long(q, s)
    near = back <= 120
    dx, dy = _NEAR[back[near] - 1].T
    back[near] = np.maximum(1, dx + dy * np.array([x.width for x in found])[image[copy[near]]])
    back[~near] -= 120
    if (back > place[copy] - first[image[copy]]).any():
        raise ValueError("a back-reference outside the image")
    n = size[copy]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start, back = np.repeat(place[copy], n), np.repeat(back, n)
    copied = start + step
    source[copied] = start - back + step % back
    _followed(source, copied)

    if len(hit):
        hits = place[hit]
        shift = np.repeat(np.array([32 - x.cache_bits for x in found], np.uint32), totals)
        image = np.repeat(np.arange(len(found)), totals)
        taken = np.zeros(len(argb), bool)
        taken[hits] = True
        slot = (argb * np.uint32(0x1E35A7BD) >> shift).astype(np.uint16)
        slot[hits] = symbol[hit] - 280
        slot[copied] = slot[source[copied]]
        while True:
            # A hit is the last pixel before it in its slot, which has this slot too, unless the slot is still unused.
            order = np.argsort(slot, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = (slot[order[1:]] != slot[order[:-1]]) | (image[order[1:]] != image[order[:-1]])
            unused = order[new & taken[order]]
            if not len(unused):
                break
            taken[unused] = False
            slot[unused] = 0
            slot[copied] = slot[source[copied]]
        last = np.maximum.accumulate(np.where(taken[order], 0, np.arange(len(order))))
        taken_at = np.flatnonzero(taken[order])
        hits = order[taken_at]
        source[hits] = order[last[taken_at]]
        _followed(source, np.concatenate([hits, copied]))
    return argb[source]


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    return tell(bits.windows, [find_symbols(bits, width, height, main)])


def _channels(argb: np.ndarray) -> np.ndarray:
    """A, R, G and B along a last axis, as wide integers."""
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _packed(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, left, up, up_left, up_right):
    average = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode <= 4:
        return (left, up, up_right, up_left)[mode - 1]
    if mode == 5:
        return average(average(left, up_right), up)
    if mode <= 9:
        return average(*((left, up_left), (left, up), (up_left, up), (up, up_right))[mode - 6])
    if mode == 10:
        return average(average(left, up_left), average(up, up_right))
    if mode == 11:
        to_left, to_up = np.abs(up - up_left).sum(), np.abs(left - up_left).sum()
        return left if to_left < to_up else up
    if mode == 12:
        return np.clip(left + up - up_left, 0, 255)
    middle = average(left, up)
    return np.clip(middle + ((middle - up_left) / 2).astype(np.int64), 0, 255)  # halves go towards zero


def undo_predictor(px: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    height, width = px.shape
    c = _channels(px)
    c[0, 0] += (255, 0, 0, 0)
    c[0] = np.cumsum(c[0], 0) & 255  # the first row takes the left pixel, the first column the upper one
    for y in range(1, height):
        row, above = c[y], c[y - 1]
        row[0] = row[0] + above[0] & 255
        kinds = modes[y >> tile]
        for x0 in range(0, width, 1 << tile):
            mode, lo, hi = int(kinds[x0 >> tile] >> 8 & 15), max(1, x0), min(width, x0 + (1 << tile))
            mode = 0 if mode > 13 else mode
            if lo >= hi:
                continue
            right = np.concatenate([above[lo + 1 : hi + 1], c[y, :1]])[: hi - lo] if hi == width else above[lo + 1 : hi + 1]
            if mode in (0, 2, 3, 4, 8, 9):
                row[lo:hi] = row[lo:hi] + _predicted(mode, None, above[lo:hi], above[lo - 1 : hi - 1], right) & 255
            elif mode == 1:
                row[lo:hi] = np.cumsum(row[lo - 1 : hi], 0)[1:] & 255
            else:
                for x in range(lo, hi):
                    row[x] = row[x] + _predicted(mode, row[x - 1], above[x], above[x - 1], right[x - lo]) & 255
    return _packed(c)


def undo_cross_colour(px: np.ndarray, factors: np.ndarray, tile: int) -> np.ndarray:
    height, width = px.shape
    f = np.repeat(np.repeat(factors, 1 << tile, 0)[:height], 1 << tile, 1)[:, :width]
    signed = lambda x: (x & 255).astype(np.uint8).view(np.int8).astype(np.int64)
    c = _channels(px)
    green = signed(c[..., 2])
    c[..., 1] += signed(f) * green >> 5
    c[..., 3] += (signed(f >> 8) * green >> 5) + (signed(f >> 16) * signed(c[..., 1]) >> 5)
    return _packed(c)


def undo_palette(px: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    n = len(colours)
    each = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    index = px >> 8 & 255
    if each:
        depth = 8 >> each
        index = (index[..., None] >> (np.arange(1 << each, dtype=np.uint32) * depth) & ((1 << depth) - 1)).reshape(len(px), -1)[:, :width]
    return np.append(colours, np.zeros(256, np.uint32))[index]


class Stream(NamedTuple):
    """A VP8L stream before its pixels are told; transforms in the order they were made."""

    width: int
    height: int
    transforms: list
    found: Symbols


def read_stream(bits: Bits) -> Stream:
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, seen, inner = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind == 3:
            colours = _channels(read_pixels(bits, n := bits.read(8) + 1, 1, False))
            colours = _packed(np.cumsum(colours, 0))
            undo.append((kind, colours, inner))
            inner = -(-inner // (8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1))
        elif kind == 2:
            undo.append((kind, None, 0))
        else:
            tile = bits.read(3) + 2
            across, down = -(-inner // (1 << tile)), -(-height // (1 << tile))
            undo.append((kind, read_pixels(bits, across, down, False).reshape(down, across), tile))
    return Stream(width, height, undo, find_symbols(bits, inner, height, True))


def undone(px: np.ndarray, transforms: list) -> np.ndarray:
    for kind, what, size in reversed(transforms):
        if kind == 0:
            px = undo_predictor(px, what, size)
        elif kind == 1:
            px = undo_cross_colour(px, what, size)
        elif kind == 2:
            green = px >> 8 & 255
            px = px & np.uint32(0xFF00FF00) | (px & np.uint32(0xFF00FF)) + (green << 16 | green) & np.uint32(0xFF00FF)
        else:
            px = undo_palette(px, what, size)
    return px


def decode_streams(data: bytes, bounds: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """The pixel arrays (height, width, 4), A R G B, of the VP8L streams at these bounds of data."""
    windows = bit_windows(data)
    streams = [read_stream(Bits(data, start, stop, windows)) for start, stop in bounds]
    argb, at, out = tell(windows, [x.found for x in streams]), 0, []
    for x in streams:
        px = undone(argb[at : at + x.found.total].reshape(x.height, x.found.width), x.transforms)
        out.append(px.astype(">u4").view(np.uint8).reshape(x.height, x.width, 4))
        at += x.found.total
    return out


def decode_vp8l(data: bytes) -> np.ndarray:
    return decode_streams(data, [(0, len(data))])[0]


class Writer:
    """Gathers bits, lowest first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def code_lengths(counts: Sequence[int], longest: int) -> list[int]:
    """Lengths of a prefix code for the symbols that occur; counts are evened out until no code is over `longest`."""
    lengths = [0] * len(counts)
    used = [s for s, n in enumerate(counts) if n]
    if len(used) < 2:
        lengths[used[0] if used else 0] = 1
        return lengths
    weights = {s: counts[s] for s in used}
    while True:
        heap = [(n, s) for s, n in weights.items()]
        heapq.heapify(heap)
        parent, node = {}, len(counts)
        while len(heap) > 1:
            n, a = heapq.heappop(heap)
            m, b = heap[0]
            parent[a] = parent[b] = node
            heapq.heapreplace(heap, (n + m, node))
            node += 1
        depth = {node - 1: 0}
        for k in range(node - 2, len(counts) - 1, -1):
            depth[k] = depth[parent[k]] + 1
        for s in used:
            lengths[s] = depth[parent[s]] + 1
        if max(lengths) <= longest:
            return lengths
        weights = {s: n + 1 >> 1 for s, n in weights.items()}


def put_code(out: Writer, lengths: Sequence[int]) -> None:
    """A prefix code as the format says it: one symbol alone, or lengths with runs, themselves in a prefix code."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        put_one_symbol(out, used[0])
        return
    said, s = [], 0
    for u in [*used, len(lengths)]:
        while (gap := min(u - s, 138)) > 0:
            said += [(0, 0, 0)] * gap if gap < 3 else [(17, gap - 3, 3)] if gap < 11 else [(18, gap - 11, 7)]
            s += gap
        if u < len(lengths):
            said.append((lengths[u], 0, 0))
            s = u + 1
    counts = [0] * 19
    for kind, _, _ in said:
        counts[kind] += 1
    outer = code_lengths(counts, 7)
    out.put(0, 1)
    shown = max(4, *(k + 1 for k, kind in enumerate(LENGTH_CODE_ORDER) if outer[kind]))
    out.put(shown - 4, 4)
    for kind in LENGTH_CODE_ORDER[:shown]:
        out.put(outer[kind], 3)
    out.put(0, 1)
    codes, value, at = _prefix(tuple(outer)).codes, 0, 0
    for kind, more, extra in said:
        code, n = codes[kind]
        value |= (code | more << n) << at
        at += n + extra
    out.put(value, at)


def put_one_symbol(out: Writer, symbol: int) -> None:
    out.put(1, 1)
    out.put(0, 1)
    out.put(1, 1)
    out.put(symbol, 8)


def copies(px: np.ndarray, image: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Back-references (place, pixels, distance), none over another or out of its image, to the last place where the next LEAST_COPY pixels stood."""
    n = len(px) - LEAST_COPY + 1
    if n < 2:
        return []
    key = px[:n].astype(np.uint64)
    for k in range(1, LEAST_COPY):
        key = key * np.uint64(0x9E3779B97F4A7C15) + px[k : k + n]
    edges = [0, n] if image is None else [0, *(np.flatnonzero(image[1:] != image[:-1]) + 1).tolist(), len(px)]
    over = 0 if image is None else LEAST_COPY - 1
    order = np.concatenate([np.argsort(key[a : b - over], kind="stable") + a for a, b in zip(edges, edges[1:], strict=False)])
    later, earlier = order[1:], order[:-1]
    same = np.flatnonzero(key[later] == key[earlier])
    later, earlier = later[same], earlier[same]
    same = np.ones(len(later), bool) if image is None else image[later] == image[earlier]
    for k in range(LEAST_COPY):
        same &= px[later + k] == px[earlier + k]
    back = np.zeros(n + 2, np.int64)
    back[later[same] + 1] = (later - earlier)[same]
    turns = np.flatnonzero(back[1:] != back[:-1])
    some = np.flatnonzero(back[turns[:-1] + 1])
    found, done = [], 0
    for start, stop, d in zip(turns[some].tolist(), (turns[some + 1] + LEAST_COPY - 1).tolist(), back[turns[some] + 1].tolist(), strict=True):
        if start < done:
            start = done
        while stop - start >= LEAST_COPY:
            size = min(MOST_COPY, stop - start)
            found.append((start, size, d))
            start = done = start + size
    return found


def _split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distances from 1 on."""
    v = values - 1
    extra = np.maximum(0, np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 2)  # the top two bits are the symbol's
    return np.where(v < 4, v, 2 * extra + (v >> extra)), np.where(v < 4, 0, v & ((1 << extra) - 1)), np.where(v < 4, 0, extra)


class Codes:
    """The codes of an image (green; red, blue and alpha alike; distance) made from counts, and the bits that say them."""

    def __init__(self, *counts: np.ndarray):
        self.said, self.codes, self.sizes = Writer(), [], []
        for k, symbols in enumerate(counts):
            lengths = code_lengths(symbols.tolist(), LONGEST)
            made = _prefix(tuple(lengths)).codes
            code, size, said = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64), Writer()
            code[list(made)], size[list(made)] = np.array(list(made.values())).T
            put_code(said, lengths)
            for _ in range(3 if k == 1 else 1):
                self.said.put(said.value, said.n)
            self.codes.append(code)
            self.sizes.append(size)

    def cost(self, *counts: np.ndarray) -> int:
        return self.said.n + sum(int(n @ size) for n, size in zip(counts, self.sizes, strict=True))


@functools.cache
def stock_codes() -> Codes:
    """Codes for any image, best for plain text."""
    byte = np.ones(256, np.int64)
    byte[32:127] = 20
    byte[32] = 6000
    byte[list(b"etaoinsrhldcumfpgwybvkxjqz")] = 18000 // np.arange(4, 30)
    copied, cached, far = 400 >> np.arange(24) // 2, np.full(1 << CACHE_BITS, 30), np.repeat([1, 6], [13, 27])
    return Codes(np.concatenate([byte, np.maximum(copied, 1), cached]), byte, far)


def _entropy(counts: np.ndarray) -> float:
    some = counts[counts > 0].astype(np.float64)
    return float(some @ np.log2(some.sum() / some)) if len(some) else 0.0


def encode_rows(*payloads: np.ndarray) -> list[bytes]:
    """A WebP file of 16 pixels a row from each payload of at most MAX_ROWS * 64 bytes, in A R G B order; what is in one depends on its payload alone."""
    px = np.concatenate(payloads).view(">u4").astype(np.uint32)
    each = np.array([len(x) // 4 for x in payloads])
    image = np.repeat(np.arange(len(each)), each)
    places, sizes, backs = np.array(copies(px, image), np.int64).reshape(-1, 3).T
    depth = np.zeros(len(px) + 1, np.int64)
    depth[places] += 1
    depth[places + sizes] -= 1
    at = np.flatnonzero(np.cumsum(depth[:-1]) == 0)  # pixels outside copies
    # A pixel is in the colour cache if the last pixel of its slot was the same.
    slot = (px * np.uint32(0x1E35A7BD)) >> np.uint32(32 - CACHE_BITS)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    hit = np.zeros(len(px), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (px[order[1:]] == px[order[:-1]]) & (image[order[1:]] == image[order[:-1]])
    plain, again = at[~hit[at]], at[hit[at]]
    length, length_bits, length_extra = _split(sizes)
    distance, distance_bits, distance_extra = _split(backs + 120)
    symbols = np.concatenate([px[plain] >> 8 & 255, 280 + slot[again], 256 + length]).astype(np.int64)
    rest = [(px[plain] >> s & 255).astype(np.int64) for s in (16, 0, 24)]
    owner = image[np.concatenate([plain, again, places])]
    a, c = slice(0, len(plain)), slice(len(plain) + len(again), None)

    def counted(width: int, *parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return sum(np.bincount(who * width + what, minlength=width * len(each)) for who, what in parts).reshape(-1, width)

    counts = [counted(280 + (1 << CACHE_BITS), (owner, symbols)), counted(256, *((owner[a], v) for v in rest)), counted(40, (owner[c], distance))]
    made, which, heads = [stock_codes()], np.zeros(len(each), np.int64), []
    for i, count in enumerate(zip(*counts, strict=True)):
        # Codes of the image's own take about 5 bits a symbol to say.
        cost = made[0].cost(*count)
        if cost > LEAST_SAVED and sum(_entropy(n) + 5 * k * np.count_nonzero(n) for n, k in zip(count, (1, 3, 1), strict=True)) + LEAST_SAVED < cost:
            which[i] = len(made)
            made.append(Codes(*count))
        out = Writer()
        for value, n in ((0x2F, 8), (15, 14), (int(each[i]) // 16 - 1, 14), (1, 1), (0, 3), (0, 1), (1, 1), (CACHE_BITS, 4), (0, 1)):
            out.put(value, n)
        out.put(made[which[i]].said.value, made[which[i]].said.n)
        heads.append(out)
    # The bits of each literal, cache hit and copy, then all of them in the order of their places.
    (code, other_code, back_code), (size, other_size, back_size) = ([np.stack(x) for x in zip(*k, strict=True)] for k in ([m.codes for m in made], [m.sizes for m in made]))
    way = which[owner]
    bits, n_bits = code[way, symbols], size[way, symbols]
    for v in rest:
        bits[a] |= other_code[way[a], v] << n_bits[a].astype(np.uint64)
        n_bits[a] += other_size[way[a], v]
    for v, n in ((length_bits, length_extra), (back_code[way[c], distance], back_size[way[c], distance]), (distance_bits, distance_extra)):
        bits[c] |= v.astype(np.uint64) << n_bits[c].astype(np.uint64)
        n_bits[c] += n
    order = np.full(len(px), -1)
    order[np.concatenate([plain, again, places])] = np.arange(len(bits))
    order = order[order >= 0]
    bits, n_bits, owner = bits[order], n_bits[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(each) + 1))
    before = np.concatenate([[0], np.cumsum(n_bits)])
    head_bits = np.array([x.n for x in heads])
    stored = head_bits + before[first[1:]] - before[first[:-1]] + 7 >> 3
    base = np.cumsum(stored) - stored
    starts = before[:-1] + np.repeat(8 * base + head_bits - before[first[:-1]], np.diff(first))
    words, shift = np.zeros((int(stored.sum()) >> 3) + 2, "<u8"), (starts & 63).astype(np.uint64)
    turns = np.flatnonzero(np.diff(starts >> 6, prepend=-1))
    words[starts[turns] >> 6] |= np.bitwise_or.reduceat(bits << shift, turns)
    words[(starts[turns] >> 6) + 1] |= np.bitwise_or.reduceat(bits >> np.uint64(1) >> np.uint64(63) - shift, turns)
    body = words.view(np.uint8)
    for x, at in zip(heads, base.tolist(), strict=True):
        head = np.frombuffer(x.bytes(), np.uint8)
        body[at : at + len(head)] |= head
    body = body.tobytes()
    return [riff(body[at : at + n]) for at, n in zip(base.tolist(), stored.tolist(), strict=True)]


def riff(stream: bytes) -> bytes:
    stream += b"\0" * (len(stream) & 1)
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode_all(payloads: Sequence[bytes]) -> list[bytes]:
    """The stored form of each payload, some made at a time: a WebP file, or several one after another."""
    out, held = [[] for _ in payloads], []

    def flush() -> None:
        for (k, _), made in zip(held, encode_rows(*(px for _, px in held)), strict=True):
            out[k].append(made)
        held.clear()

    step, waiting = MAX_ROWS * ROW, 0
    for k, payload in enumerate(payloads):
        for at in range(0, len(payload), step):
            part = np.frombuffer(payload, np.uint8)[at : at + step]
            if held and (waiting + len(part) > 4 * READ_PIXELS or len(held) == MOST_IMAGES):
                flush()
                waiting = 0
            held.append((k, part))
            waiting += len(part)
    if held:
        flush()
    return [b"".join(x) for x in out]


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]


def images(media: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Places and pixel arrays of WebP files that stand one after another, decoded some at a time."""
    at, start, pixels, places, bounds = 0, 0, 0, [], []
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("no lossless WebP file")
        n, size = struct.unpack("<I", media[at + 16 : at + 20])[0], int.from_bytes(media[at + 21 : at + 25], "little")
        after, more = at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0], ((size & 0x3FFF) + 1) * ((size >> 14 & 0x3FFF) + 1)
        if bounds and (after - start > READ_BYTES or pixels + more > READ_PIXELS):
            yield from zip(places, decode_streams(media[start:at], bounds), strict=True)
            start, pixels, places, bounds = at, 0, [], []
        places.append(at)
        bounds.append((at + 20 - start, min(at + 20 + n, len(media)) - start))
        at, pixels = after, pixels + more
    if bounds:
        yield from zip(places, decode_streams(media[start:], bounds), strict=True)


def decode(media: bytes) -> bytes:
    return b"".join(px.tobytes() for _, px in images(media))


def feature(media_px: np.ndarray) -> str:
    """Size, mean and spread of the samples, and a 64-bit sign hash of 65 column means, all of the decoded array."""
    flat = media_px.reshape(-1)
    edges = (np.arange(66) * (len(flat) / 65)).astype(np.int64)
    edges[-1] = len(flat)
    sums = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(flat, out=sums[1:])
    at, size = sums[edges], edges[1:] - edges[:-1]
    means = (at[1:] - at[:-1]) / np.maximum(1, size)
    signs = int.from_bytes(np.packbits(means[1:] > means[:-1]).tobytes(), "big")
    values = flat.astype(np.float64)
    squares, mean = float(values @ values), sums[-1] / len(flat)
    return f"{len(flat)}:{mean:.4f}:{max(0.0, squares / len(flat) - mean * mean) ** 0.5:.4f}:{signs:016x}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % ROW if data else ROW)


def store_documents(docs: DataFrame, *, keep_media: bool = False) -> DataFrame:
    """Each row of docs(doc_id, text) as lossless WebP, read back; keep_media adds the stored bytes as `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, starts = utf8(batch.column(1))
            media = encode_all([padded(cut(data, starts, i)) for i in range(batch.num_rows)])
            ends, stored = np.cumsum([len(m) for m in media]), [[] for _ in media]
            for place, px in images(b"".join(media)):
                stored[np.searchsorted(ends, place, side="right")].append(px.reshape(-1))
            rows = []
            for n, m, parts in zip(np.diff(starts).tolist(), media, stored, strict=True):
                pixels = np.concatenate(parts)
                back = pixels.tobytes()
                row = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels)]
                rows.append([*row, m] if keep_media else row)
            names = [f.split()[0] for f in SCHEMA.split(", ")] + ["media"] * keep_media
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", media binary" if keep_media else ""))


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_documents(table(spark, sf_dir, "documents"))
