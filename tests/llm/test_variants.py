"""Spelling variants against brute force on small fixtures."""

import itertools
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import variants


def near(a, b):
    at = len(os.path.commonprefix([a, b]))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at + 1 :] == b[at:] or a[at:] == b[at + 1 :])


def counted(docs):
    counts = Counter()
    for doc_id, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute(docs):
    counts = counted(docs)
    out = {}
    for w, n in counts.items():
        mates = sorted((-counts[v], v) for v in counts if near(v, w))
        form = mates[0] if mates and -mates[0][0] >= 5 * n else None
        out[w] = (n, len(mates), form and form[1], form and -form[0])

    def root(w):
        return root(out[w][2]) if out[w][2] else w

    return {(w, *x, root(w)) for w, x in out.items()}


def found(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    rows = variants.grouped(frame.repartition(3)).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def pairs(spark, words):
    got = variants.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    named = [frozenset((r.own, r.other)) for r in got]
    assert len(set(named)) == len(named)
    return set(named)


@pytest.mark.parametrize(("alphabet", "longest"), [("ab", 6), ("aéz", 4)])
def test_pairs_of_dense_words(spark, alphabet, longest):
    # All words of up to some characters, and a random half of them: nodes of every shape, runs of equal characters.
    words = ["".join(w) for n in range(1, longest + 1) for w in itertools.product(alphabet, repeat=n)]
    for chosen in (words, random.Random(len(words)).sample(words, len(words) // 2)):
        assert pairs(spark, chosen) == {frozenset(p) for p in itertools.combinations(chosen, 2) if near(*p)}


def test_pairs_of_long_words(spark):
    long = "ab" * 40_000
    words = [long, long + "c", long[:30_000] + long[30_001:], "x" + long[1:], long[:-1] + "é", "short", "shore", "shor", "horses"]
    assert pairs(spark, words) == {frozenset(p) for p in itertools.combinations(words, 2) if p[0] != p[1] and near(*p)}


def test_variants_against_brute_force(spark):
    draw = random.Random(3)
    stems = ["".join(draw.choice("aeioklmnrstÉ") for _ in range(draw.randint(6, 9))) for _ in range(40)]
    docs = []
    for i in range(400):
        words = []
        for _ in range(draw.randint(0, 60)):
            w = draw.choice(stems[: draw.choice((3, 10, 40))])
            if draw.random() < 0.1:
                at = draw.randrange(len(w))
                w = w[:at] + draw.choice(["", "e", w[at] + "e"]) + w[at + 1 :]
            words.append(w.upper() if draw.random() < 0.1 else w)
        docs.append((i, draw.choice([" ", ", ", "7", "ß-", "ÿ "]).join(words)))
    docs += [(None, "nullish " * 4), (900, None), (901, ""), (902, "abcdefg " * 3000), (3, docs[3][1]), (903, "abcdefg " * 4 + "abcdef " * 6 + "abcde " * 9)]
    docs += [(904, "chainsab " * 6), (905, "chainsa " * 31), (906, "chains " * 200)]
    want = brute(docs)
    assert sum(r[3] is not None for r in want) > 20 and sum(r[5] not in (r[0], r[3]) for r in want) > 0
    assert found(spark, docs) == want


def test_variants_of_tied_forms_and_nothing(spark):
    docs = [(i, "banana " * 50 + "bananb " * 50 + "bananz " * 2) for i in range(3)]
    assert found(spark, docs) == brute(docs)
    assert found(spark, []) == set() and found(spark, [(1, None), (2, "a b")]) == set()


def test_counts_are_sent_on_in_parts(spark, monkeypatch):
    docs = [(i, " ".join(f"word{chr(97 + j % 26)}{chr(97 + i % 7)}s" for j in range(100))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(variants, "COUNTED_BYTES", 100)
    assert {r.word: r.n for r in variants.words_of(frame).collect()} == counted(docs)
