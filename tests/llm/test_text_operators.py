"""Removal, near-duplicates, chunks, mixing, language and tokens against brute force on small fixtures."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chunking, langid, licence, mixing, neardup, suffixes
from tidemark.llm.components import connected_components

random.seed(3)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(LETTERS) for _ in range(r.randint(2, 8))) for _ in range(n))


def near(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = "changed" + str(r.randrange(999))
    return " ".join(w)


PASSAGE = prose(70, 1)
LONG = prose(30_000, 2)
ODD = [None, "", " \t\n", "one", "two words", "é" * 150, "　wide　", "x" * 70_000, "ab" * 400]


def corpus():
    texts = [prose(120, i) for i in range(10, 22)]
    texts += [texts[0], texts[0], near(texts[1], 2, 5), near(texts[1], 4, 6), near(texts[2], 9, 7)]
    texts += [prose(30, 40 + i) + " " + PASSAGE + " " + prose(25, 60 + i) for i in range(4)]
    texts += [LONG, near(LONG, 40, 8), *ODD, *ODD[:3], "a b c d e f g h i", "A  B c d\te f g h i"]
    texts += [near(texts[3], 1, 100 + i) for i in range(25)]  # a group of near copies
    return [(i, t, ["en", "de", None][i % 3], ["s0", "s1", None, "s0", "S2"][i % 5], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    # Columns whose names the operators use themselves.
    return rows.withColumns({c: F.lit("clash") for c in ("size", "start", "end", "gram", "spans", "component_id", "kept", "packed", "cut", "letters", "key", "unit", "score")}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def shingles(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def removed_bytes(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((b, gone))
    return out


def check_removal(docs, rows):
    got = {}
    for r in suffixes.remove_spans(docs.select("doc_id", "text"), suffixes.repeated_spans(docs)).select("doc_id", "cut.*").collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = {}
    for (i, *_), (b, gone) in zip(rows, removed_bytes([r[1] for r in rows], 200), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        want.setdefault(i, []).append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_repeated_bytes(docs):
    check_removal(docs, corpus())


@pytest.mark.parametrize("limits", [(1, 1_000_000), (1, 0), (3, 1_000_000)])
def test_repeated_bytes_of_hot_anchors(docs, monkeypatch, limits):
    """Few variants make an anchor hot, and few places are salted."""
    for name, value in zip(("LIMIT", "LOOKED_UP"), limits, strict=True):
        monkeypatch.setattr(suffixes, name, value)
    check_removal(docs, corpus())


def test_known_digests():
    known = np.array([[1, 5], [3, 1], [3, 4], [3, 9], [8, 2]], np.uint64)
    two = np.array([[3, 4], [3, 5], [8, 2], [9, 9], [0, 0], [3, 9]], np.uint64)
    assert suffixes._known(two, known).tolist() == [True, False, True, False, False, True]
    assert suffixes._known(two, known[:0]).tolist() == [False] * 6


def test_repeated_rows_and_null_ids(spark):
    t = prose(80, 9)
    rows = [(1, t), (1, t), (2, "z" + t), (None, t + "q"), (None, None), (3, prose(80, 10)), (3, prose(80, 11))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_removal(docs, rows)


def test_suffix_sort_orders_suffixes():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[500:900] = data[1500:1900]
    text, starts = suffixes.Prefixes(data), np.sort(r.choice(2700, 300, replace=False))
    order = suffixes.sort_suffixes(text, starts, np.zeros(300, np.int64))
    want = sorted(range(300), key=lambda i: (data[starts[i] : starts[i] + 200].tobytes(), i))
    assert order.tolist() == want
    dup = suffixes.repeated_windows(text, starts, np.zeros(300, np.int64))
    seen = Counter(data[s : s + 200].tobytes() for s in starts)
    assert dup.tolist() == [seen[data[s : s + 200].tobytes()] > 1 for s in starts]


def test_near_duplicates(docs):
    rows = corpus()
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 75 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    want = {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x4F00))), LETTERS + LETTERS.upper() + "0123456789+/"])
def test_shifted_passage_in_unspaced_text(spark, letters):
    """Passages without white space are found at other offsets: Chinese characters, base64."""
    r = random.Random(6)
    run = lambda n: "".join(r.choice(letters) for _ in range(n))
    long, short = run(4000), run(500)
    texts = [run(211) + long + run(900), run(1000) + long + run(77), run(401) + short + run(30), short + run(303)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id: x.text for x in chunking.deduplicate(docs).collect()}
    assert kept[0] == texts[0] and kept[2] == texts[2]
    assert len(texts[1]) - 4000 <= len(kept[1]) <= len(texts[1]) - 3500
    assert len(texts[3]) - 500 <= len(kept[3]) <= len(texts[3]) - 200
    for t in texts:
        ends = chunking.cuts(np.frombuffer(t.encode(), np.uint8))
        assert max(np.diff([0, *ends])) < chunking.MOST_CHUNK and all(t.encode()[a:b].decode() for a, b in zip([0, *ends], ends))


def template_family(n, pairs, seed=11):
    """n texts on one template, each with words of its own, and copies of the first `pairs` at a similarity of about 0.77."""
    r, base = random.Random(seed), prose(200, seed).split()

    def changed(words, k, name):
        words = list(words)
        for j, at in enumerate(r.sample(range(0, 200, 6), k)):
            words[at] = f"{name}x{j}"
        return words

    texts = [changed(base, 6, f"own{i}") for i in range(n)]
    return [" ".join(t) for t in texts + [changed(texts[i], 5, f"copy{i}") for i in range(pairs)]]


def test_near_duplicates_among_thousands_of_one_template(spark):
    """A region of far more rows than NEIGHBOURS, whose rows are mutually unlinked, hides no pair."""
    texts = template_family(2000, 40)
    random.Random(1).shuffle(texts)
    sets = [shingles(t) for t in texts]
    tokens = {s: k for k, s in enumerate({s for x in sets for s in x})}
    has = np.zeros((len(sets), len(tokens)), np.float32)
    for i, x in enumerate(sets):
        has[i, [tokens[s] for s in x]] = 1
    both = has @ has.T
    size = has.sum(1)
    a, b = np.nonzero(np.triu(100 * both >= 75 * (size[:, None] + size[None, :] - both), 1))
    want = list(range(len(texts)))
    for _ in texts:
        before = list(want)
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            want[i] = want[j] = min(want[i], want[j])
        if want == before:
            break
    assert 20 <= len(texts) - len(set(want)) <= 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("block", [1 << 19, 1 << 13])
def test_shared_counts_and_blocks(monkeypatch, spark, block):
    """Blocks of any size, sparse and dense tokens give the counts and links of plain sets."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = template_family(60, 12, 5)
    sets = neardup.text_sets(*_buffer(texts))
    for dense in (0, 200, 4096):
        monkeypatch.setattr(neardup, "DENSE", dense)
        assert (neardup.shared_counts(sets[:50], sets[50:]) == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[50:]] for x in sets[:50]]).all()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = neardup.signatures(docs)
    none = spark.createDataFrame([(i, 0) for i in range(60, 66)] + [(0, 0)], "node long, component long")
    more = neardup.region_links(signed.select("doc_id", "n_shingles", "keys"), none, docs)
    assert {tuple(sorted(r)) for r in more.collect()} >= {(i, 60 + i) for i in range(6, 12)}


def _buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])


def test_near_duplicates_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, None), (7, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted([(-1, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (-1, 0, None, True)], key=lambda x: (x[0], x[1]))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(9, 9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 500 for k in range(500, 540)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_equal_union_find(spark):
    """Random graphs of several densities, with loops, repeated edges and nulls."""
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(400)]
    edges += edges[:20] + [(None, 3), (5, None)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(root)}


@pytest.mark.parametrize("limit", [0, 1000])
def test_texts_of_ids(spark, docs, monkeypatch, limit):
    """The wanted texts are the same with ids broadcast and joined."""
    monkeypatch.setattr(neardup, "BROADCAST_IDS", limit)
    ids = docs.filter("doc_id % 3 = 0").select("doc_id").union(docs.filter("doc_id % 3 = 0").select("doc_id"))
    assert sorted(map(str, neardup.only(docs, ids).collect())) == sorted(map(str, docs.filter("doc_id % 3 = 0").select("doc_id", "text").collect()))


def test_chunks_cover_texts_and_resist_insertions():
    text = np.frombuffer(prose(400, 12).encode(), np.uint8)
    ends = chunking.cuts(text)
    assert ends == sorted(set(ends)) and ends[-1] == len(text)
    moved = np.concatenate([np.frombuffer(b"inserted words here ", np.uint8), text])
    pieces = lambda t, e: {t[a:b].tobytes() for a, b in zip([0, *e], e, strict=False)}
    assert len(pieces(text, ends) & pieces(moved, chunking.cuts(moved))) > 0.9 * len(ends)
    assert all(b"\xc3\xa9".startswith(bytes([x])) for x in [np.frombuffer(("é" * 3000).encode(), np.uint8)[e] for e in chunking.cuts(np.frombuffer(("é" * 3000).encode(), np.uint8))[:-1]])


def test_repeated_passages_go_and_clean_texts_stay(docs):
    rows = corpus()
    cut = {r.doc_id: r for r in chunking.remove_spans(docs.select("doc_id", "text"), chunking.repeated_spans(docs), chunking.LEAST_RUN, keep_text=True).select("doc_id", "cut.*").collect()}
    assert len(cut) == len(rows)
    six = {i: {tuple(w[k : k + 6]) for k in range(len(w) - 5)} for i, text, *_ in rows for w in [words(text)]}
    seen, places = set(), Counter(g for s in six.values() for g in s)
    for i, text, *_ in rows:
        w = words(text)
        grams = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        if grams & seen:
            assert cut[i].n_removed > 0, i
        if len(w) > 5 and all(places[g] == 1 for g in six[i]):
            assert cut[i].n_removed == 0 and cut[i].kept_text == text
        seen |= grams


def plain_chunks(raw):
    """Ends of chunks, byte by byte with a rolling hash."""
    white, gear = set(b" \t\n\x0b\x0c\r"), [int(g) for g in chunking.GEAR]
    h, last, out = 0, 0, []
    for i, byte in enumerate(raw):
        h = ((h << 1) + gear[byte]) & 0xFFFFFFFF
        top, end = h >> 28, i + 1
        whole = end == len(raw) or raw[end] & 0xC0 != 0x80
        dense = end >= 32 and not white & set(raw[end - 32 : end]) and whole
        strong = top == 0 and (byte in white or dense)
        if end < len(raw) and not (strong and end - last >= 24 or byte in white and top < 8 and end - last >= 40):
            continue
        while end - last > 1024:
            last += 1024
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def test_substring_dedup_equals_brute_force(docs):
    """Chunks of every text, the first place of each, and the runs of others of 80 bytes or more."""
    texts = {r[0]: (r[1] or "").encode() for r in corpus()}
    places = []
    for i, raw in texts.items():
        at = 0
        for end in plain_chunks(raw):
            places.append((i, zlib.crc32(raw), at, end, raw[at:end]))
            at = end
    first = {}
    for i, crc, at, _, piece in sorted(places):
        first.setdefault(piece, (i, crc, at))
    want = {}
    for i, raw in texts.items():
        runs = []
        for d, crc, at, end, piece in places:
            if d == i and first[piece] != (d, crc, at):
                if runs and runs[-1][1] == at:
                    runs[-1][1] = end
                else:
                    runs.append([at, end])
        gone = [r for r in runs if r[1] - r[0] >= 80]
        kept, at = b"", 0
        for a, b in gone:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        want[i] = (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
    rows = docs.select("doc_id", "text")
    found = suffixes.remove_spans(rows, chunking.repeated_spans(rows), chunking.LEAST_RUN).select("doc_id", "cut.*").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want and sum(w[1] for w in want.values()) > 3000


def test_deduplicate_keeps_columns(docs):
    assert chunking.deduplicate(docs).columns == docs.columns


def mixed(spark, rows):
    return mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()


def targets(sizes):
    """Water filling by rounds: shares by weight, full ones stop, the rest is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not full:
            return out | share
        out |= {s: 3 * sizes[s] for s in full}
        open_ -= full
    return out


def test_mixing_targets_and_taken_words(spark):
    r = random.Random(4)
    rows = [(i, prose(r.randint(1, 60), i), r.choice(["a", "a", "a", "b", "B", "é", None])) for i in range(900)] + [(9000, None, "a"), (9001, "  ", "void"), (9002, "one", "tiny")]
    rows += [(5, rows[5][1], rows[5][2])] * 3
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = targets(dict(sizes))
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    taken = Counter()
    for g in got:
        assert g.target == pytest.approx(want[g.source]) and g.source_size == sizes[g.source]
        assert 0 <= g.taken <= 3 * g.size and (g.taken % g.size == 0 if g.size else g.taken == 0)
        taken[g.source] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60, s
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixed(spark, rows)))


def test_mixing_is_fair(spark):
    """Over seeds a document's copies come near its source's rate."""
    rows = [(i, "w " * 10, "a" if i < 60 else "b") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    sums = Counter()
    for seed in range(12):
        for r in mixing.mix_sources(docs, f"seed {seed}").collect():
            sums[r.doc_id < 60] += r.copies
    assert sums[True] / (12 * 60) == pytest.approx(10 / 7, rel=0.02) and sums[False] / (12 * 60) == pytest.approx(4 / 7, rel=0.02)


def test_language_id_learns_and_rejects(spark):
    parts = {"aa": ["the", "ing", "and", "th"], "bb": ["ung", "sch", "der", "ich"], "cc": ["ção", "que", "os", "não"]}
    r = random.Random(6)
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(2)) for _ in range(40)), k) for i in range(240) for k in [list(parts)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (None, rows[0][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert len(found) == len(rows)
    assert np.mean([found[i].lang_pred == k for i, _, k in rows[:240]]) > 0.97
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and not found[i].accepted for i in (1000, 1001, 1002))
    assert all(0 <= f.score <= 1 for f in found.values())
    kept = langid.keep_accepted(docs, langid.fit(docs))
    assert kept.columns == docs.columns and kept.count() >= 230
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_language_id_on_held_out_rows(spark):
    """Rows that nothing was learned from: accuracy of each language and of all."""
    parts = {"aa": ["the", "ing", "and", "th"], "bb": ["ung", "sch", "der", "ich"], "cc": ["ção", "que", "os", "não"], "dd": ["the", "und", "que", "ed"]}
    r = random.Random(16)
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(2)) for _ in range(r.randint(12, 60))), k) for i in range(600) for k in [list(parts)[i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    found = {x.doc_id: x for x in langid.predict(docs, langid.fit(docs.filter(~F.col("doc_id").isin(list(held))))).collect()}
    by = {k: [found[i].lang_pred == k for i in held if rows[i][2] == k] for k in parts}
    assert len(held) > 120 and all(len(v) > 20 and np.mean(v) >= 0.95 for v in by.values())


@pytest.mark.parametrize("name", sorted(licence.LICENCES))
def test_licences_in_other_forms(spark, name):
    """Wraps of any width, comment marks, titles, notices and bullets leave a licence what it is; other sentences don't."""
    text = licence.LICENCES[name]
    lines = lambda width: [x for part in text.split("\n") for x in (textwrap.wrap(part, width) or [""])]
    shapes = ["\n".join(lines(w)) for w in (34, 61, 78)] + ["/*\n" + "\n".join(" * " + x for x in lines(70)) + "\n */", "\n".join("# " + x for x in lines(72)), "\n".join("// " + x for x in lines(72))]
    shapes += [f"{t}\n\nCopyright (c) 2019-2024, The Authors\nAll rights reserved.\n\n{text}" for t in licence.TITLES.get(name, [""])]
    shapes += [text.upper(), text.replace("license", "licence")]
    other = [text + " And you owe us a beer.", text[: len(text) // 2]]
    docs = spark.createDataFrame(list(enumerate(shapes + other)), "doc_id long, text string")
    got = [x.licence_id for x in licence.scan_licences(docs).orderBy("doc_id").collect()]
    assert got == [name] * len(shapes) + [None] * len(other)


def test_licences(spark):
    mit = licence.LICENCES["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " , ")), (2, mit.replace("sublicense", "sub-licence")), (3, mit + " And more."), (4, None), (5, ""), (6, "RELEASED under the MIT Licence!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence_id", F.lit("clash"))
    got = {r.doc_id: r.licence_id for r in licence.scan_licences(docs).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "MIT notice"}


def test_byte_bpe_equals_tiktoken(docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] or "" for r in corpus()}
    got = bpe.encode_documents(docs, path, P.PATTERN, keep_ids=True).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_tables(empty):
    import public_tokenizers as P

    assert suffixes.remove_spans(empty.select("doc_id", "text"), suffixes.repeated_spans(empty)).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert chunking.deduplicate(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0 and mixing.repeat_documents(empty).count() == 0
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert licence.scan_licences(empty).count() == 0
    assert bpe.encode_documents(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_pipeline_stages_keep_columns(docs, spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "mixing", "byte_bpe"]
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, "")
        if name != "byte_bpe":
            assert rows.columns == docs.columns
    out = rows.collect()
    assert out and all(r.n_tokens == len(r.ids) for r in out)


def test_pipeline_stages_equal_brute_force(docs, spark):
    """Each stage on its predecessor's rows: what stays, what is cut, how often, and which ids."""
    import base64

    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    stages = dict(corpus_pipeline.STAGES)
    rows = docs.withColumns({c: F.lit("clash") for c in ("mix_words", "mix words x", "mix_times", "mix_at")})
    before = {r.doc_id: r for r in rows.collect()}
    kept = {r.doc_id: r for r in stages["near_dedup"](spark, rows, "").collect()}
    sets, group = {i: shingles(r.text) for i, r in before.items()}, {i: i for i in before}
    for _ in range(len(sets)):  # labels spread until none changes
        new = {a: min(group[b] for b in sets if a == b or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])) for a in sets}
        if new == group:
            break
        group = new
    assert set(kept) == {i for i in sets if group[i] == i} and all(kept[i] == before[i] for i in kept)

    left = stages["near_dedup"](spark, rows, "").cache()
    cut = {r.doc_id: r for r in stages["substring_dedup"](spark, left, "").collect()}
    assert set(cut) == set(kept)
    clean = [i for i in cut if i not in (17, 18, 19, 20) and i < 12]
    assert all(cut[i].text == kept[i].text for i in clean)
    assert sum(PASSAGE[60:-60] in (cut[i].text or "") for i in cut) == 1  # the passage that four documents share stays once
    assert all(cut[i].n_chars == len(cut[i].text or "") and cut[i].mix_words == "clash" for i in cut if cut[i].text is not None)

    mixed = stages["mixing"](spark, left, "").collect()
    taken = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix_sources(left).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in taken.items() if n}) and all(r == kept[r.doc_id] for r in mixed)

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    assert {r.doc_id: r.ids for r in stages["byte_bpe"](spark, left, "").collect()} == {i: own.encode_ordinary(r.text or "") for i, r in kept.items()}
