"""Spelling variants: words one edit apart, by merging the light subtrees of a trie with one character off.

The words form a trie. Of a node's children the one with most words is heavy (ties: smallest code point); an edge to another
child, or the end of a word at a node with children, is light, and a word has at most log2(words) light edges on its way. Two
words part at one node, so at least one of them leaves it by a light edge there. Small-to-large merging copies only that
word's rest into the place where the other word's rest lies, with one character skipped or replaced:

    R  the light character replaced by the heavy one: the rest in the heavy subtree
    L  the light character replaced by a wildcard: the rests of all light subtrees of the node
    S  the light character skipped: the rest among the words below the node itself
    I  the heavy character put before it (skipped in the other word): the whole in the heavy subtree

Terminals that coincide give the pairs, each once. The trie is never built in one place: a node is the polynomial hash of its
prefix, its children's word counts are a grouping, its light edges a join of the words' prefixes with the nodes that branch
(salted near the root, where every word passes), and a merged terminal is a hash computed from prefix hashes at no cost a
character. Coinciding hashes are only candidates: the words without the node's character decide. Hashes that collide can therefore add
candidates but lose none, since every node has one heavy child for all its words whatever else shares its hash.

Null and empty texts have no words. A null doc_id counts as an empty string before the colon. Words may be as long as a text:
work and rows grow with their length, never with its square. No words give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, steps, table, utf8, written

#: Runs whose crc32 this divides lose a character.
DIVISOR = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Bytes of distinct words that a task counts before it sends them on.
COUNTED_BYTES = 8 << 20
#: Characters of words that one numpy step hashes, at least a word.
STEP_CHARACTERS = 1 << 16
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
#: Two primes under 2^31 and a base for each: a hash is a pair of sums of (code point x power), packed in a long.
PRIMES, BASES = (2147483647, 2147483629), (1_000_003, 69_069_069)


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n, as they come from tasks: words may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        held = 0
        for batch in steps(batches):
            data, starts = utf8(batch.column(1))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                # Bytes of UTF-8 are lower-cased in A-Z alone; a shorter run makes no word, as it only loses characters.
                own = Counter(RUN.findall(cut(data, starts, i).lower().decode()))
                salt, before = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id)), len(counts)
                for word, n in own.items():
                    crc = zlib.crc32(word.encode(), salt)
                    if crc % DIVISOR == 0:
                        at = crc % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    if word not in counts:
                        held += len(word) + 100
                    counts[word] += n
                if len(counts) != before and held > COUNTED_BYTES:
                    yield flush()
                    counts.clear()
                    held = 0
        if counts:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")


def words_of(docs: DataFrame) -> DataFrame:
    """Words of LEAST_COUNT occurrences or more, with n."""
    return word_counts(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Hashes:
    """Prefix hashes of some words, and the hashes of what becomes of a word by one edit."""

    def __init__(self, words: pa.Array):
        text = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) for w in words.to_pylist()], np.int64)
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.place = np.arange(len(text)) - np.repeat(self.starts[:-1], sizes)
        self.text, self.powers, self.sums = text, [], []
        for p, b in zip(PRIMES, BASES, strict=True):
            powers = powers_of(b, int(sizes.max(initial=0)) + 2, p)
            self.powers.append(powers)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(text * powers[self.place] % np.uint64(p), dtype=np.uint64)]))

    def prefix(self, which: int, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Hash of the first k characters of each word."""
        p, sums = np.uint64(PRIMES[which]), self.sums[which]
        return (sums[self.starts[word] + k] - sums[self.starts[word]]) % p

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, depth, hash and next character (0 at the end) of every node that a word passes."""
        word = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        depth = np.arange(len(word)) - np.repeat(self.starts[:-1] + np.arange(len(self.sizes)), self.sizes + 1)
        at = np.minimum(self.starts[word] + depth, max(len(self.text) - 1, 0))
        letter = np.where(depth < self.sizes[word], self.text[at].astype(np.int64), 0)
        return word, depth, packed(self.prefix(0, word, depth), self.prefix(1, word, depth)), letter

    def whole(self) -> np.ndarray:
        word = np.arange(len(self.sizes))
        return packed(*(self.prefix(i, word, self.sizes) for i in (0, 1)))

    def merged(self, word: np.ndarray, depth: np.ndarray, heavy: np.ndarray) -> dict[str, np.ndarray]:
        """Hashes by kind of errata; of R, S and I as of a whole word, of L within its node."""
        end, parts = self.sizes[word], {"R": [], "S": [], "I": [], "L": []}
        own = self.text[np.minimum(self.starts[word] + depth, len(self.text) - 1)]
        rest_at = np.minimum(depth + 1, end)
        heavy = heavy.astype(np.uint64)
        for i, p in enumerate(map(np.uint64, PRIMES)):
            powers, whole, head = self.powers[i], self.prefix(i, word, end), self.prefix(i, word, depth)
            rest = (whole + p - self.prefix(i, word, rest_at)) % p
            back = np.uint64(pow(BASES[i], -1, PRIMES[i]))
            put = heavy * powers[depth] % p
            parts["R"].append((head + put + rest) % p)
            parts["S"].append((head + rest * back) % p)
            parts["I"].append((head + put + (whole + p - head) % p * powers[1]) % p)
            parts["L"].append((head + rest + np.uint64(0x110000) * powers[depth]) % p)
        found = {kind: packed(*pair) for kind, pair in parts.items()}
        # The skipped character's follower leads into the subtree it came from if they are equal: the next node has that pair.
        follower = np.where(depth + 1 < end, self.text[np.minimum(self.starts[word] + depth + 1, len(self.text) - 1)], 0)
        found["skips"] = (depth < end) & (follower != own)
        return found


def powers_of(base: int, count: int, p: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    return out


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(31) | b).astype(np.int64)


def in_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return steps(batches, "word", STEP_CHARACTERS)


def salts(depth: F.Column) -> F.Column:
    """Into how many parts a node's words are dealt: all words pass the root."""
    return F.when(depth == 0, 128).when(depth <= 2, 32).when(depth <= 5, 4).otherwise(1)


def light_edges(words: DataFrame) -> DataFrame:
    """id and edges of each word: depth and heavy character of the nodes that it leaves by a light edge or ends at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            word, depth, node, letter = Hashes(batch.column(0)).nodes()
            for at in range(0, len(word), STEP_CHARACTERS):
                part = slice(at, at + STEP_CHARACTERS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(2).to_numpy()[word[part]]), pa.array(depth[part].astype(np.int32)), pa.array(node[part]), pa.array(letter[part].astype(np.int32))], ["id", "depth", "node", "letter"]
                )

    paths = words.select("word", "n", "id").mapInArrow(run, "id long, depth int, node long, letter int")
    children = paths.groupBy("depth", "node", "letter").agg(F.count("*").alias("below"))
    heaviest = F.max_by("letter", F.when(F.col("letter") > 0, F.struct("below", -F.col("letter"))))
    nodes = children.groupBy("depth", "node").agg(heaviest.alias("heavy"), F.count("*").alias("ways")).filter("ways > 1").drop("ways")
    nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts(F.col("depth")) - 1)))
    salted = paths.withColumn("salt", F.pmod(F.xxhash64("id"), salts(F.col("depth"))).cast("int"))
    light = salted.join(nodes, ["depth", "node", "salt"]).filter(F.col("letter") != F.col("heavy"))
    return light.groupBy("id").agg(F.collect_list(F.struct("depth", "heavy")).alias("edges"))


def errata(words: DataFrame) -> DataFrame:
    """The merged terminals: kind, key (hash), depth of the node, own (the word it was made from), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            edges = batch.column(2)
            word = np.repeat(np.arange(batch.num_rows), edges.value_lengths().to_numpy())
            flat = edges.flatten()
            depth, heavy = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            hashes = Hashes(batch.column(0))
            found = hashes.merged(word, depth, heavy)
            goes_on = depth < hashes.sizes[word]
            for kind, which in (("R", goes_on), ("L", goes_on), ("S", found["skips"]), ("I", np.ones(len(word), bool))):
                rows = pa.array(word[which])
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), pa.array(found[kind][which]), pa.array(depth[which].astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], ["kind", "key", "depth", "own", "n"])

    return words.join(light_edges(words), "id").select("word", "n", "edges").mapInArrow(run, "kind string, key long, depth int, own string, n long")


def terminals(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(Hashes(batch.column(0)).whole()), batch.column(0), batch.column(1)], ["key", "other", "other_n"])

    return words.select("word", "n").mapInArrow(run, "key long, other string, other_n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of words that are one edit apart, once: own, n, other, other_n."""
    words = words.withColumn("id", F.monotonically_increasing_id())
    words = written(words, "variants-words")
    merged = written(errata(words), "variants-errata")
    met = merged.filter("kind <> 'L'").join(terminals(words), "key")
    # Light rests of one node that coincide: as many at most as there are characters in the alphabet.
    lights = merged.filter("kind = 'L'")
    among = lights.join(lights.select("key", F.col("own").alias("other"), F.col("n").alias("other_n")), "key").filter(F.col("own") < F.col("other"))
    without = lambda word: F.concat(F.substring(word, F.lit(1), F.col("depth")), F.substring(word, F.col("depth") + 2, F.length(word)))
    own, other = F.col("own"), F.col("other")
    skipped, added = (F.col("kind") == "S") & (without(own) == other), (F.col("kind") == "I") & (own == without(other))
    replaced = F.col("kind").isin("R", "L") & (F.length(own) == F.length(other)) & (without(own) == without(other)) & (own != other)
    return met.unionByName(among).filter(skipped | added | replaced).select("own", "n", "other", "other_n")


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form and form_n of each word."""
    pairs = near_pairs(words)
    back = pairs.select(F.col("other").alias("own"), F.col("other_n").alias("n"), F.col("own").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("word")))
    found = pairs.unionByName(back).groupBy("own").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(found.withColumnRenamed("own", "word"), "word", "left")
    lent = F.col("n") * times <= -F.col("best.order")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(lent, F.col("best.word")).alias("form"), F.when(lent, -F.col("best.order")).alias("form_n"))


def with_roots(rows: DataFrame) -> DataFrame:
    """rows with `root`: forms followed to the last, each round twice as far. n grows along the way, so that it ends."""
    steps_left = written(rows.filter("form is not null").select("word", F.col("form").alias("root")), "variants-root")
    while True:
        onward = steps_left.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = written(steps_left.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-root")
        if found.filter("moved").isEmpty():
            break
        steps_left = found.drop("moved")
    return rows.join(steps_left, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame) -> DataFrame:
    words = written(words_of(docs), "variants-counts")
    return with_roots(written(forms(words), "variants-forms")).select("word", "n", "n_near", "form", "form_n", "root")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))
