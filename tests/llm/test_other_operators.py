"""WARC archives, lossless WebP and exact vector search on small fixtures."""

import hashlib
import struct
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import mtree, warc, webp

HTML = "<p>" + "word " * 60 + "</p>"


def test_loser_tree_merges():
    r = np.random.default_rng(2)
    runs = [sorted(r.integers(0, 50, n).tolist()) for n in (0, 1, 7, 30, 5, 0, 12)]
    assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(sum(runs, []))
    assert list(warc.LoserTree([])) == [] and list(warc.LoserTree([iter([]), iter([])])) == []


def test_archives_round_trip(spark):
    rows = [(5, "http://b.example.com/x?Q=1#f", HTML), (2, "https://www.a.example.org", HTML), (9, None, HTML), (None, "http://c.example/", HTML), (3, "http://b.example.com/x", "short"), (4, "u", "short"), (6, "http://e/ \n", None), (2, "https://www.a.example.org", HTML)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit("clash"))
    merged = warc.merge_captures(warc.read_archives(warc.write_archives(pages)))
    out = merged.collect()
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in out)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for i, _, t in rows:
        revisit = t == HTML and i != 2
        want.append((i or -1, len((t or "").encode()), sha(t), "revisit" if revisit else "response", 2 if revisit else -1))
    assert got == sorted(want)
    order = [(r.url_key, r.captured, r.page_id if r.page_id is not None else -1) for r in sorted(out, key=lambda r: (r.merge_part, r.merge_place))]
    assert order == sorted(order)
    assert warc.merge_captures(warc.read_archives(warc.write_archives(pages.limit(0)))).count() == 0


def test_url_keys(spark):
    urls = ["http://www2.Example.com:80/A?b=C#d", "https://u:p@m.example.co.uk", "no scheme", None, "http://x.org/"]
    got = [r.k for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").orderBy("i").select(warc.url_key(F.col("url")).alias("k")).collect()]
    assert got == ["com,example)/a?b=c", "uk,co,example,m)/", "no scheme", "", "org,x)/"]


class Stream(webp.Writer):
    """Writes small streams of any kind: codes as lists of lengths, symbols by canonical code."""

    def code(self, lengths, alphabet):
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) == 1 and used[0] < 256:
            webp.put_one_symbol(self, used[0])
        else:
            self.put(0, 1)
            self.put(15, 4)
            order = webp.LENGTH_CODE_ORDER
            kinds = sorted(set(lengths) | {0})
            width = max(1, (len(kinds) - 1).bit_length())
            outer = [0] * 19
            for k, n in enumerate(kinds):  # a complete code: the last symbols are one bit shorter where there is room
                outer[n] = width
            spare = (1 << width) - len(kinds)
            fill = [n for n in range(15, -1, -1) if n not in kinds][:spare]
            for n in fill:
                outer[n] = width
            for s in order:
                self.put(outer[s], 3)
            self.put(0, 1)
            table = self.canonical(outer)
            for n in lengths:
                self.put(*table[n])
        return self.canonical(lengths)

    @staticmethod
    def canonical(lengths):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if len(used) == 1:
            return {used[0][1]: (0, 0)}
        out, code, last = {}, 0, 0
        for n, s in used:
            code <<= n - last
            last = n
            out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
            code += 1
        return out

    def pixels(self, px, cache=0, main=True, back=None):
        """px as literals with flat codes of the symbols that occur; back: (position, length, distance code symbol, extra) in place of literals."""
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        if main:
            self.put(0, 1)
        px = [int(p) for p in px]
        symbols, at, table = [], 0, {}
        shift = 32 - cache
        while at < len(px):
            if back and at == back[0]:
                symbols.append(("copy", back))
                for p in px[at : at + back[1]]:
                    table[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift if cache else 0] = p
                at += back[1]
                continue
            p = px[at]
            slot = (0x1E35A7BD * p & 0xFFFFFFFF) >> shift if cache else 0
            symbols.append(("cache", slot) if cache and table.get(slot) == p else ("pixel", p))
            table[slot] = p
            at += 1
        green = {s[1] >> 8 & 255 if s[0] == "pixel" else 280 + s[1] if s[0] == "cache" else 256 + self.split(s[1][1])[0] for s in symbols}
        parts = [green] + [{s[1] >> k & 255 for s in symbols if s[0] == "pixel"} or {0} for k in (16, 0, 24)] + [{s[1][2] for s in symbols if s[0] == "copy"} or {0}]
        tables = []
        for used, size in zip(parts, (280 + (1 << cache if cache else 0), 256, 256, 256, 40), strict=True):
            used = sorted(used)
            lengths = [0] * size
            if len(used) == 1 and used[0] > 255:
                used = [0, *used]
            if len(used) == 1:
                lengths[used[0]] = 1
            else:
                width = (len(used) - 1).bit_length()
                short = (1 << width) - len(used)
                for k, s in enumerate(used):
                    lengths[s] = width - 1 if k < short else width
            tables.append(self.code(lengths, size))
        for kind, v in symbols:
            if kind == "pixel":
                for t, k in zip(tables[:4], (8, 16, 0, 24), strict=True):
                    self.put(*t[v >> k & 255])
            elif kind == "cache":
                self.put(*tables[0][280 + v])
            else:
                s, extra, bits = self.split(v[1])
                self.put(*tables[0][256 + s])
                self.put(extra, bits)
                self.put(*tables[4][v[2]])
                self.put(v[3][0], v[3][1])

    @staticmethod
    def split(n):
        n -= 1
        if n < 4:
            return n, 0, 0
        high = n.bit_length() - 1
        second = n >> (high - 1) & 1
        return 2 * high + second, n & ((1 << (high - 1)) - 1), high - 1

    def head(self, w, h):
        self.put(0x2F, 8)
        self.put(w - 1, 14)
        self.put(h - 1, 14)
        self.put(1, 1)
        self.put(0, 3)


def picture(w, h, seed, colours=None):
    r = np.random.default_rng(seed)
    if colours:
        return r.choice(np.array(colours, np.uint32), (h, w))
    return r.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32)


def argb(px):
    return np.stack([px >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.uint8)


@pytest.mark.parametrize("w,h,cache", [(1, 1, 0), (5, 3, 0), (16, 9, 4), (31, 7, 11)])
def test_webp_literals_and_colour_cache(w, h, cache):
    px = picture(w, h, w, [0x11223344, 0xFF00FF00, 0x80FF1001, 7] if cache else None)
    out = Stream()
    out.head(w, h)
    out.put(0, 1)
    out.pixels(px.ravel(), cache)
    assert (webp.decode_vp8l(out.bytes()) == argb(px)).all()


@pytest.mark.parametrize("cache", [0, 3])
def test_webp_back_reference(cache):
    row = picture(8, 1, 3, [1, 0xFF020304, 0x10203040])[0]
    px = np.concatenate([row, row, row, [9]])
    out = Stream()
    out.head(len(px), 1)
    out.put(0, 1)
    # Distance 8 in a single row: code 8 + 120 as symbol and extra bits, overlapping itself.
    symbol, extra, bits = Stream.split(128)
    out.pixels(px, cache, back=(8, 16, symbol, (extra, bits)))
    assert (webp.decode_vp8l(out.bytes())[0] == argb(px)).all()


def test_webp_palette():
    colours = [0xFF000000, 0xFFFFFFFF, 0x80402010]
    px = picture(11, 5, 4, colours)
    out = Stream()
    out.head(11, 5)
    out.put(1, 1)
    out.put(3, 2)
    out.put(len(colours) - 1, 8)
    c = argb(np.array(colours, np.uint32)).astype(np.int64)
    steps = np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255
    out.pixels([a << 24 | r << 16 | g << 8 | b for a, r, g, b in steps.tolist()], main=False)
    out.put(0, 1)
    index = np.vectorize(colours.index)(px)
    packed = np.zeros((5, 3), np.uint32)
    for x in range(11):
        packed[:, x // 4] |= (index[:, x] << (2 * (x % 4))).astype(np.uint32)
    out.pixels((packed << 8).ravel())
    assert (webp.decode_vp8l(out.bytes()) == argb(px)).all()


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictor(mode):
    w, h = 9, 6
    c = argb(picture(w, h, 40 + mode)).astype(int)
    left = np.zeros_like(c)
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = [255, 0, 0, 0] if x == 0 else c[0, x - 1]
            elif x == 0:
                p = c[y - 1, 0]
            else:
                L, T, TL, TR = c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], c[y - 1, x + 1] if x + 1 < w else c[y, 0]
                av = lambda a, b: (a + b) // 2
                half = lambda a: np.trunc(a / 2).astype(int)
                near = T if abs(L - TL).sum() >= abs(T - TL).sum() else L
                p = [[255, 0, 0, 0], L, T, TR, TL, av(av(L, TR), T), av(L, TL), av(L, T), av(TL, T), av(T, TR), av(av(L, TL), av(T, TR)), L if abs(T - TL).sum() < abs(L - TL).sum() else T, np.clip(L + T - TL, 0, 255), np.clip(av(L, T) + half(av(L, T) - TL), 0, 255)][mode]
                del near
            left[y, x] = (c[y, x] - p) & 255
    out = Stream()
    out.head(w, h)
    out.put(1, 1)
    out.put(0, 2)
    out.put(0, 3)
    out.pixels([mode << 8] * (-(-w // 4) * -(-h // 4)), main=False)
    out.put(0, 1)
    out.pixels([a << 24 | r << 16 | g << 8 | b for a, r, g, b in left.reshape(-1, 4).tolist()])
    assert (webp.decode_vp8l(out.bytes()) == c).all()


def test_webp_cross_colour_and_subtract_green():
    w, h = 6, 5
    c = argb(picture(w, h, 77)).astype(int)
    g2r, g2b, r2b = 17, -30, 90
    s8 = lambda x: ((x & 255) ^ 128) - 128
    g, r = s8(c[..., 2]), s8(c[..., 1])
    d = c.copy()
    d[..., 1] = c[..., 1] - (g2r * g >> 5) & 255
    d[..., 3] = c[..., 3] - (g2b * g >> 5) - (r2b * r >> 5) & 255
    d2 = d.copy()
    d2[..., 1] = d[..., 1] - d[..., 2] & 255
    d2[..., 3] = d[..., 3] - d[..., 2] & 255
    out = Stream()
    out.head(w, h)
    out.put(1, 1)
    out.put(1, 2)
    out.put(0, 3)
    out.pixels([255 << 24 | r2b << 16 | (g2b & 255) << 8 | g2r] * 4, main=False)
    out.put(1, 1)
    out.put(2, 2)
    out.put(0, 1)
    out.pixels([a << 24 | r << 16 | g << 8 | b for a, r, g, b in d2.reshape(-1, 4).tolist()])
    assert (webp.decode_vp8l(out.bytes()) == c).all()


def test_webp_groups_of_codes():
    r = np.random.default_rng(6)
    w, h, across = 9, 6, 3
    meta = [0, 1, 1, 1, 0, 0]
    pairs, rest = [(3, 200), (7, 90)], [(1, 2, 255), (40, 50, 60)]
    out = Stream()
    out.head(w, h)
    out.put(0, 2)  # no transform, no cache
    out.put(1, 1)
    out.put(0, 3)  # tiles of 4 x 4
    out.pixels([g << 8 for g in meta], main=False)
    for (low, high), one in zip(pairs, rest, strict=True):
        for value, n in ((1, 1), (1, 1), (1, 1), (low, 8), (high, 8)):
            out.put(value, n)
        for s in (*one, 0):
            webp.put_one_symbol(out, s)
    want = np.zeros((h, w, 4), int)
    for y in range(h):
        for x in range(w):
            g = meta[(y >> 2) * across + (x >> 2)]
            bit = int(r.integers(0, 2))
            out.put(bit, 1)
            red, blue, alpha = rest[g]
            want[y, x] = alpha, red, pairs[g][bit], blue
    assert (webp.decode_vp8l(out.bytes()) == want).all()


def test_webp_hits_of_unused_slots():
    # Slots are 0 at first; such a hit's pixel, 0, then goes to slot 0.
    pixel = 0x01020503
    used = (0x1E35A7BD * pixel & 0xFFFFFFFF) >> 28
    other = next(k for k in (3, 5) if k != used)
    symbols = [280 + other, 5, 280, 280 + other, 280 + used, 5, 280 + used]
    want = [0, pixel, 0, 0, pixel, pixel, pixel]
    out = Stream()
    out.head(len(want), 1)
    out.put(0, 1)
    out.put(1, 1)
    out.put(4, 4)
    out.put(0, 1)
    lengths = [0] * 296
    for s in {*symbols}:
        lengths[s] = 2
    told = out.code(lengths, 296)
    for s in (2, 3, 1, 0):
        webp.put_one_symbol(out, s)
    for s in symbols:
        out.put(*told[s])
    assert (webp.decode_vp8l(out.bytes())[0] == argb(np.array(want, np.uint32))).all()


def test_webp_images_do_not_depend_on_their_neighbours(monkeypatch):
    r = np.random.default_rng(5)
    texts = [b"", r.bytes(3000), b"the same words " * 400, b"the same words " * 40, bytes(r.integers(97, 101, 60_000).astype(np.uint8)), b"a", b"the same words " * 400]
    payloads = [webp.padded(t) for t in texts]
    media = webp.encode_all(payloads)
    assert media == [webp.encode(p) for p in payloads] and webp.encode_all([]) == []
    assert webp.decode(b"".join(media)) == b"".join(payloads)
    monkeypatch.setattr(webp, "MAX_ROWS", 5)
    monkeypatch.setattr(webp, "READ_PIXELS", 100)
    small = webp.encode_all(payloads)
    assert small == [webp.encode(p) for p in payloads] and webp.decode(b"".join(small)) == b"".join(payloads)
    places = [at for at, _ in webp.images(b"".join(small))]
    assert len(places) == sum(-(-len(p) // 320) for p in payloads) and places == sorted({*places}) and places[0] == 0


def test_webp_reader_takes_few_python_steps():
    """Lines of the reader that Python runs for a pixel of plain text: about 17 when every code was looked up on its own."""
    r = np.random.default_rng(9)
    text = bytes(r.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 40_000))
    media, lines = webp.encode(webp.padded(text)), 0

    def trace(frame, event, _):
        nonlocal lines
        if frame.f_code.co_filename != webp.__file__:
            return None
        lines += event == "line"
        return trace

    webp.decode(media)
    before = sys.gettrace()
    sys.settrace(trace)
    try:
        back = webp.decode(media)
    finally:
        sys.settrace(before)
    assert back == webp.padded(text) and lines < 8 * len(back) // 4


def test_webp_rejects_damage():
    media = webp.encode(webp.padded(b"hello"))
    with pytest.raises(ValueError):
        webp.decode(media[:30] + media[40:])
    with pytest.raises(ValueError):
        webp.decode(b"RIFX" + media[4:])


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 64, bytes(range(256)) * 9, b"long " * 300_000])
def test_webp_round_trip(text):
    payload = webp.padded(text)
    assert len(payload) % 64 == 0 and len(payload) and webp.decode(webp.encode(payload)) == payload


def test_webp_writer_uses_the_format(monkeypatch):
    r = np.random.default_rng(4)
    words = [bytes(r.integers(97, 123, n).tolist()) for n in r.integers(2, 9, 300)]
    prose = b" ".join(words[k] for k in r.zipf(1.3, 20_000) % 300)
    cases = {"stock": prose[:900] * 3, "own": prose + prose[:4000] * 2, "noise": r.bytes(9000), "zeros": b"", "one": b"abcd" * 5000}
    made = []
    codes = webp.Codes
    monkeypatch.setattr(webp, "Codes", lambda *counts: made.append(counts) or codes(*counts))
    webp.stock_codes()
    own = {}
    for name, text in cases.items():
        payload, made[:] = webp.padded(text), []
        media = webp.encode(payload)
        own[name] = len(made)
        assert webp.decode(media) == payload
        assert name == "noise" or len(media) < max(0.7 * len(payload), 600)
    assert own["own"] == 1 and own["stock"] == 0
    px = np.frombuffer(webp.padded(cases["own"]), np.uint8).view(">u4").astype(np.uint32)
    found = webp.copies(px)
    assert found and all((px[a : a + n] == px[np.arange(a - d, a - d + n)]).all() and n >= webp.LEAST_COPY for a, n, d in found)
    assert all(a + n <= b for (a, n, _), (b, _, _) in zip(found, found[1:], strict=False))
    literals, copied, hits = (int(c.sum()) for c in np.split(_greens(webp, px), [256, 280]))
    assert literals and hits and copied


def _greens(webp, px):
    """Counts of green symbols of the writer's stream, as the reader meets them."""
    counts = np.zeros(280 + (1 << webp.CACHE_BITS), np.int64)
    seen = []
    cost = webp.stock_codes().cost
    webp.stock_codes().cost = lambda *c: seen.append(c) or cost(*c)
    try:
        webp.encode_rows(px.astype(">u4").view(np.uint8))
    finally:
        del webp.stock_codes().cost
    counts += seen[0][0]
    return counts


@given(st.binary(max_size=400), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_webp_round_trip_of_any_bytes(data, times):
    payload = webp.padded(data * times)
    assert webp.decode(webp.encode(payload)) == payload


def test_stored_documents(spark):
    rows = [(1, None), (2, ""), (3, "é" * 40), (4, "x" * 100_000), (3, "é" * 40), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = webp.store_documents(docs, keep_media=True).collect()
    assert len(got) == len(rows)
    texts = {i: (t or "").encode() for i, t in rows}
    for r in got:
        payload = webp.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert struct.unpack("<I", r.media[4:8])[0] + 8 == len(r.media)
    assert len({r.feature for r in got if r.doc_id in (1, 2)}) == 1
    assert webp.store_documents(docs.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    r = np.random.default_rng(8)
    base = r.normal(0, 0.2, (40, 12))
    rows = [(i, [float(x) for x in (base[i % 40] if i % 3 else r.normal(0, 0.2, 12))], 1) for i in range(700)]
    rows += [(700, None, 1), (701, [None] * 12, 1), (702, [float("nan")] * 12, 1), (703, [], 1), (704, [1.0, 2.0], 1), (None, [0.1] * 12, 1), (3, rows[3][1], 1), (100, rows[100][1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    monkeypatch.setattr(mtree, "BLOCK", 150)
    monkeypatch.setattr(mtree, "QUERIES", 3)
    monkeypatch.setattr(mtree, "ROOTS", 2)
    got = {}
    for x in mtree.top_k(vectors, F.col("id") % 100 == 0).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    good = [(i, np.floor(np.float32(v).astype(np.float64) * 1024).astype(int)) for i, v, _ in rows if i is not None and i < 700]
    want = {}
    for q in range(0, 700, 100):
        v = dict(good)[q]
        best = sorted(((-int(v @ c), i) for i, c in good if i != q))[:10]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == want
    few = mtree.top_k(vectors.filter("vec_id in (0, 1)"), F.col("id") == 0).collect()
    assert [(x.rank, x.vec_id) for x in few] == [(1, 1)]
    assert mtree.top_k(vectors.limit(0), F.col("id") == 0).count() == 0


@pytest.mark.parametrize(("spread", "kinds"), [(1.0, 6), (1e5, 400), (1e-3, 400)])
def test_stored_tree_search(spread, kinds):
    """Trees of equal, of far and of nearly equal vectors, read back, give what all products give; floors leave out what is below."""
    r = np.random.default_rng(3)
    base = r.normal(0, spread, (kinds, 9))
    rows = np.floor(1024 * (base[r.integers(0, kinds, 900)] + (r.random((900, 1)) < 0.2) * r.normal(0, spread, (900, 9)))).astype(np.int64)
    ids = r.permutation(900)
    tree = mtree.MTree.load(mtree.MTree.build(ids, rows).stored())
    queries, own = rows[:50], ids[:50]
    every = queries @ rows.T
    floor = np.where(np.arange(50) % 2, np.sort(every, 1)[:, -4], mtree.NONE)
    scores, found = tree.search(queries, own, 10, floor)
    for q in range(50):
        best = sorted((-int(s), int(i)) for s, i in zip(every[q], ids, strict=True) if i != own[q] and s >= floor[q])[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores[q], found[q], strict=True) if s > mtree.NONE] == best


def test_top_k_of_large_components(spark):
    """Components beyond 2 ** 21 are exact; what might not fit a long takes no part."""
    rows = [(0, [2e6, 1.5]), (100, [-1.99e6, 2.0]), (1, [1e6 + 0.001, 7.0]), (2, [4e5, -9.25]), (3, [1e300, 1.0]), (4, [2e6, 1.501])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in mtree.top_k(vectors, F.col("id") % 100 == 0).collect()}
    good = {i: [int(np.floor(1024 * c)) for c in v] for i, v in rows if i != 3}
    for q in (0, 100):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)
        assert [got[q, k + 1] for k in range(4)] == [(i, -s) for s, i in best]
    assert len(got) == 8
