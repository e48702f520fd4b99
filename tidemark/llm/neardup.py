"""Near-duplicates by MinHash and an LSH forest, confirmed on full shingle sets.

Each document's set of hashed 5-word shingles gives TREES signature orders of DEPTH levels. Documents with one set
form a class, and only its representative goes on. Each tree's keys are sorted over the cluster (ranges of tree, key
and id, so that equal keys of a large group are cut too), and each row is a candidate partner of its next NEIGHBOURS
rows that share at least LEAST levels: where a region is thin that is every row of the prefix, where it is dense the
rows of the longest common prefixes, so depth adapts to the region. Rows at range borders are paired in a second
step. Every candidate pair is confirmed on the full sets; components follow from confirmed links and classes.
Regions of more rows that the links so far leave in several components are then done exactly (see `region_links`).

Defined results: null or blank text has no shingles, no links, and its own component; equal sets are linked; rows
that share a doc_id count as one node; a null doc_id belongs to the component of its class; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import steps, table, utf8, written
from tidemark.llm.components import connected_components
from tidemark.llm.shingles import mix, shingle_hashes, word_hashes

WORDS = 5
TREES = 24
DEPTH = 6
LEAST = 3
NEIGHBOURS = 6
FUNCTIONS = 96
LEVEL_BYTES = 2
#: Shingles (rows count as 512 at least) of a block of a large region, and the work of a token from which it is done in a dense product.
BLOCK = 1 << 19
LEAST_WEIGHT = 512
DENSE = 4096
#: Ids that are broadcast at most (16 bytes each: 64 MB).
BROADCAST_IDS = 4_000_000


def multipliers() -> np.ndarray:
    return mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def tree_levels() -> np.ndarray:
    """The function of each tree's levels: the first four are the tree's own, deeper ones are borrowed from other trees."""
    own = np.arange(FUNCTIONS).reshape(TREES, -1)
    borrowed = [np.roll(own[:, k % own.shape[1]], 7 * k + 3) for k in range(DEPTH - own.shape[1])]
    return np.column_stack([own, *borrowed])


def text_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(data, starts)
    return [np.unique(shingle_hashes(words[first[i] : first[i + 1]], WORDS)) for i in range(len(starts) - 1)]


def tree_keys(sets: list[np.ndarray]) -> list[list[bytes]]:
    """For each (non-empty) set its key in each tree: DEPTH levels of two bytes."""
    if not sets:
        return []
    every = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), FUNCTIONS), np.uint64)
    for k, a in enumerate(multipliers()):
        least[:, k] = np.minimum.reduceat(every * a, at)
    keys = (mix(least) >> np.uint64(48)).astype(">u2")[:, tree_levels()]
    return [[key.tobytes() for key in rows] for rows in keys]


SIGNATURE = "doc_id long, n_shingles long, set_id binary, keys array<binary>"


def signatures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 20):
            sets = text_sets(*utf8(batch.column(1)))
            keys = iter(tree_keys([s for s in sets if len(s)]))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SIGNATURE)


def _neighbours(borders: bool):
    """Pairs of near rows of sorted (tree, key, doc_id, n); with `borders` also the partition's first and last rows (u is null).

    Rows pass in batches, and only the last NEIGHBOURS of those before are held.
    """

    def ends(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in rows.combine_chunks().to_batches():
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *b.select(["tree", "key", "doc_id", "n"]).columns], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if borders and seen < NEIGHBOURS:
                yield from ends(rows.slice(0, NEIGHBOURS - seen))
            before = held.num_rows if held is not None else 0
            rows = pa.concat_tables([held, rows]) if before else rows
            yield from _near_rows(rows, before)
            seen += batch.num_rows
            held = rows.slice(max(0, rows.num_rows - NEIGHBOURS))
        if borders and held is not None:
            last = min(NEIGHBOURS, max(0, seen - NEIGHBOURS))  # the first rows are sent already
            if last:
                yield from ends(held.slice(held.num_rows - last))

    return run


def _near_rows(rows: pa.Table, before: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows at most NEIGHBOURS apart that share LEAST levels, the second of which isn't among the first `before`."""
    count = rows.num_rows
    tree, doc, n = (rows.column(c).to_numpy() for c in ("tree", "doc_id", "n"))
    key = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint8).reshape(count, -1)[:, : LEAST * LEVEL_BYTES]
    new = np.ones(count, bool)
    new[1:] = (tree[1:] != tree[:-1]) | (key[1:] != key[:-1]).any(1)
    region = np.cumsum(new)
    for k in range(1, min(NEIGHBOURS, count - 1) + 1):
        i = np.flatnonzero(region[k:] == region[:-k])
        i = i[i + k >= before]
        u, v, small, large = doc[i], doc[i + k], np.minimum(n[i], n[i + k]), np.maximum(n[i], n[i + k])
        fit = (u != v) & (4 * small >= 3 * large)
        yield _pair_batch(np.minimum(u, v)[fit], np.maximum(u, v)[fit])


NAMES = ["u", "v", "tree", "key", "doc_id", "n"]
NEAR = "u long, v long, tree int, key binary, doc_id long, n long"


def _pair_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(u), t) for t in (pa.int32(), pa.binary(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), *none], names=NAMES)


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """Distinct pairs u < v of reps(doc_id, n_shingles, keys) that are near in some tree."""
    rows = reps.select(F.posexplode("keys").alias("tree", "key"), "doc_id", F.col("n_shingles").alias("n"))
    ranges = rows.repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    near = written(ranges.mapInArrow(_neighbours(True), NEAR), "forest-pairs")
    # At most 2 * NEIGHBOURS rows of each range: a table as small as the number of partitions.
    border = near.filter("u is null").select("tree", "key", "doc_id", "n").coalesce(1).sortWithinPartitions("tree", "key", "doc_id")
    across = border.mapInArrow(_neighbours(False), NEAR)
    return near.filter("u is not null").select("u", "v").union(across.select("u", "v")).distinct()


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids. Up to BROADCAST_IDS of them are broadcast, so that other texts aren't shuffled; beyond, Spark joins."""
    ids = written(ids.distinct(), "minhash-ids")
    held = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(held, "doc_id", "left_semi")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text, for shuffles that carry whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in steps(batches):
            data, starts = utf8(batch.column(1))
            texts = [pack(data[starts[i] : starts[i + 1]].tobytes()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, packed binary")


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    texts = [unpack(b) for b in blobs]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


def confirmed_pairs(pairs: DataFrame, docs: DataFrame, threshold: int = 75) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= threshold * union. A document has few partners: the trees bound them."""
    own = pairs.select("u").distinct().select(F.col("u").alias("doc_id"), "u", F.lit(0).alias("role"))
    need = own.union(pairs.select(F.col("v").alias("doc_id"), "u", F.lit(1).alias("role")))
    rows = need.join(packed(only(docs, need.select("doc_id"))), "doc_id").repartition("u").sortWithinPartitions("u", "role", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                doc, u, role = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "u", "role"))
                sets = text_sets(*unpacked(part.column(part.schema.get_field_index("packed")).to_pylist()))
                found = []
                for i, (d, hub, r) in enumerate(zip(doc, u, role, strict=True)):
                    if r == 0:
                        at, mine = hub, sets[i]
                    elif at == hub:
                        shared = len(np.intersect1d(mine, sets[i], assume_unique=True))
                        if shared and 100 * shared >= threshold * (len(mine) + len(sets[i]) - shared):
                            found.append((hub, d))
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("u", "role", "doc_id", "packed").mapInArrow(run, "a long, b long")


def open_regions(reps: DataFrame) -> DataFrame:
    """Rows (doc_id) of reps(doc_id, n_shingles, keys, label) that share a region too large for NEIGHBOURS and of several labels, with the region's least label as `hub`."""
    rows = reps.select(F.posexplode("keys").alias("tree", "key"), "doc_id", "label")
    rows = rows.select("tree", F.substring("key", 1, LEAST * LEVEL_BYTES).alias("region"), "doc_id", "label")
    least = F.min("label").alias("hub"), F.max("label").alias("high")
    large = rows.groupBy("tree", "region").agg(F.count("*").alias("rows"), *least).filter((F.col("rows") > NEIGHBOURS + 1) & (F.col("hub") < F.col("high")))
    large = written(large.select("tree", "region", "hub"), "forest-regions")
    return rows.join(large, ["tree", "region"]).select("doc_id", "label", "hub").distinct()


def block_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members(doc_id, n_shingles, label, area) with their block, and the pairs of blocks that may hold a link of two labels.

    Sizes fall into classes such that linked sets are in one class or the next. Labels of less than a block are dealt to
    mixed blocks by hash; a larger label has blocks of its own, which need not meet each other.
    """
    weight = F.sum(F.greatest("n_shingles", F.lit(LEAST_WEIGHT)))
    members = members.withColumn("size", F.floor(F.log("n_shingles") / F.log(F.lit(4 / 3))))
    group, spread = ["area", "size"], lambda c: F.ceil(c / BLOCK)
    labels = written(members.groupBy(*group, "label").agg(weight.alias("weight")), "region-labels")
    mixed = labels.filter(F.col("weight") <= BLOCK).groupBy(*group).agg(spread(F.sum("weight")).alias("parts"))
    own = F.when(F.col("weight") > BLOCK, F.col("label"))
    dealt = labels.join(mixed, group, "left").select(*group, "label", own.alias("own"), F.when(own.isNotNull(), spread(F.col("weight"))).otherwise(F.col("parts")).alias("parts"))
    part = F.pmod(F.xxhash64(F.when(F.col("own").isNotNull(), F.col("doc_id")).otherwise(F.col("label"))), F.col("parts"))
    blocked = members.join(dealt, [*group, "label"]).withColumn("part", part)
    blocked = written(blocked.withColumn("block", F.xxhash64(*group, F.coalesce("own", F.lit(-1)), F.col("own").isNull(), "part")), "region-blocks")
    blocks = blocked.select("area", "size", "own", "block").distinct()
    other = blocks.select("area", *[F.col(c).alias(f"{c}_2") for c in ("size", "own", "block")])
    meet = (F.abs(F.col("size") - F.col("size_2")) <= 1) & (F.col("block") <= F.col("block_2"))
    pairs = blocks.join(other, "area").filter(meet & F.coalesce(F.col("own") != F.col("own_2"), F.lit(True)))
    return blocked, pairs.select("block", "block_2", F.xxhash64("block", "block_2").alias("meeting"))


def shared_counts(ours: list[np.ndarray], theirs: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each of our sets with each of theirs."""
    n, m = len(ours), len(theirs)
    out = np.zeros(n * m, np.float64)
    tokens = np.intersect1d(np.concatenate(ours), np.concatenate(theirs))
    if not len(tokens):
        return out.reshape(n, m)

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
        good = np.flatnonzero(tokens[at] == flat)
        order = good[np.argsort(at[good], kind="stable")]
        return at[order], row[order], np.searchsorted(at[order], np.arange(len(tokens) + 1))

    (a, a_row, a_at), (b, b_row, b_at) = entries(ours), entries(theirs)
    often = np.diff(a_at) * np.diff(b_at) > DENSE
    place, dense = np.cumsum(often) - 1, np.zeros((n, m), np.float32)
    a_often, b_often = often[a], often[b]
    for k in range(0, int(often.sum()), 1024):
        left, right = np.zeros((n, 1024), np.float32), np.zeros((m, 1024), np.float32)
        for side, token, row, some in ((left, a, a_row, a_often), (right, b, b_row, b_often)):
            here = some & (place[token] >= k) & (place[token] < k + 1024)
            side[row[here], place[token[here]] - k] = 1
        dense += left @ right.T
    rare = np.flatnonzero(~a_often)
    width = np.diff(b_at)[a[rare]]
    ends = np.cumsum(width)
    done = 0
    while done < len(rare):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 21), side="right")))
        w, some = width[done:stop], rare[done:stop]
        within = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        out += np.bincount(np.repeat(a_row[some], w) * m + b_row[np.repeat(b_at[a[some]], w) + within], minlength=n * m)
        done = stop
    return out.reshape(n, m) + dense


def new_links(ours: tuple, theirs: tuple, threshold: int) -> list[tuple[int, int]]:
    """Pairs of labels that linked pairs between two blocks (labels, sets) join, so many as are needed for that."""
    (u_label, u_sets), (v_label, v_sets) = ours, theirs
    shared = shared_counts(u_sets, v_sets)
    either = np.array([len(s) for s in u_sets])[:, None] + np.array([len(s) for s in v_sets])[None, :] - shared
    hit = (shared > 0) & (100 * shared >= threshold * either) & (np.array(u_label)[:, None] != np.array(v_label)[None, :])
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
        a, b = top(u_label[i]), top(v_label[j])
        if a != b:
            root[a] = b
            out.append((u_label[i], v_label[j]))
    return out


def region_links(reps: DataFrame, found: DataFrame, docs: DataFrame, threshold: int = 75) -> DataFrame | None:
    """Links between components (as labels a, b) that candidates of NEIGHBOURS rows miss: all pairs of different components in large regions, on full sets.

    Regions that share rows make one area, so that a pair meets once and not in each tree. An area's rows are cut into
    blocks, blocks meet in pairs over the cluster, and a meeting gives only the links that join components.
    """
    labels = found.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    reps = reps.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    rows = written(open_regions(reps), "region-rows")
    if rows.isEmpty():
        return None
    # Rows of one label are one node: what is linked already needs no edges.
    areas = connected_components(rows.select(F.col("label").alias("a"), F.col("hub").alias("b")))
    areas = areas.select(F.col("node").alias("label"), F.col("component").alias("area"))
    members = rows.select("doc_id", "label").distinct().join(areas, "label").join(reps.select("doc_id", "n_shingles"), "doc_id")
    blocked, pairs = block_pairs(members.select("doc_id", "n_shingles", "label", "area"))
    pairs = written(pairs, "region-pairs")
    sides = pairs.select("block", "meeting", F.lit(0).alias("side"))
    sides = sides.union(pairs.filter("block <> block_2").select("block_2", "meeting", F.lit(1)))
    texts = written(blocked.select("doc_id", "label", "block").join(packed(only(docs, blocked.select("doc_id"))), "doc_id"), "region-texts")
    rows = texts.join(sides, "block").repartition("meeting").sortWithinPartitions("meeting", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[tuple]) -> pa.RecordBatch:
            sides = [([], []) for _ in range(2)]
            for side, *values in held:
                for kept, value in zip(sides[side], values, strict=True):
                    kept.append(value)
            pairs = new_links(sides[0], sides[1] if sides[1][0] else sides[0], threshold) if sides[0][0] else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        at, held = None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                meeting, side, label, blobs = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("meeting", "side", "label", "packed"))
                for here, *row in zip(meeting, side, label, text_sets(*unpacked(blobs)), strict=True):
                    if here != at and held:
                        yield links(held)
                        held = []
                    at = here
                    if len(row[-1]):
                        held.append(tuple(row))
        if held:
            yield links(held)

    return written(rows.select("meeting", "side", "label", "packed").mapInArrow(run, "a long, b long"), "region-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text)."""
    signed = written(signatures(docs), "minhash")
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("rep"))
    classes = written(classes.select("set_id", "rep.*"), "minhash-classes")
    pairs = written(candidate_pairs(classes.select("doc_id", "n_shingles", "keys")), "minhash-pairs")
    links = written(confirmed_pairs(pairs, docs), "minhash-links")
    found = connected_components(links)
    more = region_links(classes.select("doc_id", "n_shingles", "keys"), found, docs)
    if more is not None and not more.isEmpty():
        # A component of these may be a row alone so far: the joined components are nodes of their own.
        joined = connected_components(more).select(F.col("node").alias("label"), F.col("component").alias("joined"))
        rows = found.select("node", F.col("component").alias("label")).union(joined.select("label", "label")).distinct()
        found = rows.join(joined, "label", "left").select("node", F.coalesce("joined", "label").alias("component"))
    classes = classes.select("set_id", F.col("doc_id").alias("node")).join(found, "node", "left")
    classes = classes.select("set_id", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END)) AS shingle
  FROM worded
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS MATERIALIZED (
  SELECT x, y FROM met JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), both_ways AS MATERIALIZED (
  SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked
), reached(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reached r JOIN both_ways l ON r.b = l.x
), named AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id::BIGINT AS component_id, d.doc_id = component_id AS kept
FROM documents d JOIN named USING (doc_id) LEFT JOIN sized USING (doc_id)
"""
