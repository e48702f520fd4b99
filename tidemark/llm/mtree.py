"""Exact top-k by inner product: best-first search in stored M-trees, nearest trees first.

Vectors are rounded to integers, so scores are exact. Rows go to the nearest of up to CENTRES sampled vectors, and each
such cell is cut into trees of about `block` rows at most. A tree is built once and stored: pages of at most PAGE entries, each entry
with a routing vector, a covering radius, the greatest length below it and its distance to the parent's routing vector.
The root entries of all trees make a directory. Each query first searches the tree whose root may hold the best
score, then only the trees whose bound reaches its k-th score so far. With d at least the distance from the query to
any vector of a ball, a score is at most (|q|^2 + max|x|^2 - d^2) / 2 and at most q.c + |q| r. Stored parent distances
bound d by the triangle inequality before an entry's own distance is computed. Bounds carry a slack for rounding, so
no answer is lost. Queries come to trees (never trees to queries), and many visit a page together.

Vectors of one length without near ones have no bound that spares a tree: each query then meets every tree, at one
matrix product a page. That is the work that exact search has on such data.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those whose integer
vector has a squared length of 2 ** 62 or more (their scores might not fit a long); vectors of another length than most are
compared on equal length alone; ties go to the smaller id; with fewer than k candidates all are returned; rows that
share an id with the query are not its candidates; repeated rows are candidates each, and ask once; null ids take no
part; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

SCALE = 1024
#: Rows of a tree: so many at most, and so few at least where the cluster has cores for more trees.
BLOCK, LEAST_BLOCK = 16384, 1024
#: Cells that rows are dealt to (a bound on the sample of their centres), queries that search together, roots compared at a time.
CENTRES = 256
QUERIES = 1024
ROOTS = 4096
PAGE = 64
LONGEST = 2.0**62
NONE = -(1 << 62)  # below every score
ARRAYS = ["ids", "rows", "row_parent", "begin", "end", "leaf", "centre", "radius", "most", "to_parent", "child"]


class MTree:
    """Pages hold rows begin to end (leaf), or entries begin to end, each with the page below it; the root page is the last."""

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, seed: int = 5) -> MTree:
        tree = cls()
        exact, tree.floats, tree.rng = rows, rows.astype(np.float64), np.random.default_rng(seed)
        tree.norm2 = (tree.floats**2).sum(1)
        tree.order, tree.near, tree.entries, tree.pages = [], [], [], []
        tree.held = 0
        centre = tree.floats.mean(0)
        tree._page(np.arange(len(ids)), centre)
        order = np.concatenate(tree.order)
        tree.ids, tree.rows, tree.row_parent = ids[order], exact[order], np.concatenate(tree.near)
        tree.begin, tree.end, tree.leaf = (np.array(c) for c in zip(*tree.pages, strict=True))
        none = np.zeros(0)
        columns = zip(*tree.entries, strict=True) if tree.entries else (none.reshape(0, rows.shape[1]), none, none, none, none.astype(np.int64))
        tree.centre, tree.radius, tree.most, tree.to_parent, tree.child = (np.array(c) for c in columns)
        tree._ready()
        return tree

    def _page(self, members: np.ndarray, centre: np.ndarray) -> int:
        if len(members) <= PAGE:
            self.order.append(members)
            self.near.append(np.sqrt(((self.floats[members] - centre) ** 2).sum(1)))
            self.pages.append((self.held, self.held + len(members), True))
            self.held += len(members)
        else:
            made = []
            for group in self._split(members):
                own = self.floats[group].mean(0)
                radius = float(np.sqrt(((self.floats[group] - own) ** 2).sum(1).max()))
                made.append((own, radius, float(self.norm2[group].max()), float(np.sqrt(((own - centre) ** 2).sum())), self._page(group, own)))
            self.pages.append((len(self.entries), len(self.entries) + len(made), False))
            self.entries += made
        return len(self.pages) - 1

    def _split(self, members: np.ndarray) -> list[np.ndarray]:
        """Up to PAGE groups around routing vectors drawn from the members; equal vectors are cut into even parts."""
        n = min(PAGE, -(-len(members) // PAGE))
        picks = self.floats[self.rng.choice(members, n, replace=False)]
        near = ((picks**2).sum(1) - 2 * self.floats[members] @ picks.T).argmin(1)
        groups = [g for g in (members[near == k] for k in range(n)) if len(g)]
        return groups if len(groups) > 1 else np.array_split(members, n)

    def _ready(self) -> None:
        self.floats = self.rows.astype(np.float64)
        self.norm2 = (self.floats**2).sum(1)
        self.most_length = float(np.sqrt(self.norm2.max(initial=0)))

    def root(self) -> tuple[np.ndarray, float, float]:
        """Routing vector, covering radius and greatest squared length of the whole tree."""
        centre = self.floats.mean(0)
        return centre, float(np.sqrt(((self.floats - centre) ** 2).sum(1).max())), float(self.norm2.max())

    def stored(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in ARRAYS})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> MTree:
        tree = cls()
        with np.load(io.BytesIO(blob)) as held:
            for k in ARRAYS:
                setattr(tree, k, held[k])
        tree._ready()
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the scores and ids of its best k rows of score `floor` or more but those with id `own`; NONE where there are fewer."""
        q = queries.astype(np.float64)
        q2 = (q**2).sum(1)
        length = np.sqrt(q2)
        slack = 1e-6 * (length + self.most_length) ** 2 + 1e-3
        exact = float(length.max(initial=0)) * self.most_length < 2.0**52
        scores, ids = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
        worst = np.maximum(floor, NONE)
        centre = self.floats.mean(0)
        far = np.sqrt(np.maximum(0, ((q - centre) ** 2).sum(1)))
        tie = count()
        queue = [(-np.inf, next(tie), len(self.begin) - 1, np.arange(len(q)), np.full(len(q), np.inf), far)]
        while queue:
            best, _, page, active, bound, distance = heapq.heappop(queue)
            if -best < worst.min():
                break
            good = bound >= worst[active]
            active, distance = active[good], distance[good]
            if not len(active):
                continue
            part = slice(self.begin[page], self.end[page])
            a2, room, need = q2[active, None], slack[active, None], worst[active, None]
            if self.leaf[page]:
                least = np.abs(distance[:, None] - self.row_parent[part])  # rows that the page's distance rules out
                use = ((a2 + self.norm2[part] - least**2) / 2 + room >= need).any(0)
                own_ids = self.ids[part][use]
                dot = np.rint(q[active] @ self.floats[part][use].T).astype(np.int64) if exact else queries[active] @ self.rows[part][use].T
                hit = (dot >= need) & (own_ids != own[active, None])
                some = np.flatnonzero(hit.any(1))
                if len(some):
                    at, hit = active[some], hit[some]
                    all_scores = np.concatenate([scores[at], np.where(hit, dot[some], NONE)], 1)
                    all_ids = np.concatenate([ids[at], np.where(hit, own_ids, np.iinfo(np.int64).max)], 1)
                    order = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
                    scores[at], ids[at] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
                    worst[at] = np.maximum(worst[at], scores[at, -1])
                continue
            # No distance is computed for entries that the page's own rules out for all.
            least = np.maximum(0, np.abs(distance[:, None] - self.to_parent[part]) - self.radius[part])
            use = np.flatnonzero(((a2 + self.most[part] - least**2) / 2 + room >= need).any(0)) + part.start
            centres = self.centre[use]
            dot = q[active] @ centres.T
            apart = np.sqrt(np.maximum(0, a2 + (centres**2).sum(1) - 2 * dot))
            least = np.maximum(0, apart - self.radius[use])
            bounds = np.minimum(dot + length[active, None] * self.radius[use], (a2 + self.most[use] - least**2) / 2) + room
            for j, entry in enumerate(use.tolist()):
                on = np.flatnonzero(bounds[:, j] >= need[:, 0])
                if len(on):
                    heapq.heappush(queue, (-float(bounds[on, j].max()), next(tie), int(self.child[entry]), active[on], bounds[on, j], apart[on, j]))
        return scores, ids


def root_bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The most that a query's score can be in each tree."""
    q2, c2 = (queries**2).sum(1)[:, None], (centre**2).sum(1)
    dot = queries @ centre.T
    least = np.maximum(0, np.sqrt(np.maximum(0, q2 + c2 - 2 * dot)) - radius)
    slack = 1e-6 * (np.sqrt(q2) + np.sqrt(most)) ** 2 + 1e-3
    return np.minimum(dot + np.sqrt(q2) * radius, (q2 + most - least**2) / 2) + slack


def integers(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, width and vec (eight bytes a component) of the rows that take part."""
    x = F.col(column)
    good = x.isNotNull() & F.col(id_column).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    long = F.aggregate(x, F.lit(0.0), lambda s, c: s + F.pow(F.abs(c.cast("double")) * SCALE + 1, F.lit(2.0)))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    rows = vectors.filter(F.coalesce(good, F.lit(False))).filter(long < LONGEST).select(F.col(id_column).cast("long").alias("id"), scaled.alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(1)
            starts = vec.offsets.to_numpy().astype(np.int64)
            values = vec.values.to_numpy(zero_copy_only=False).astype("<i8")
            raw = [values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts).astype(np.int32)), pa.array(raw, pa.binary())], names=["id", "width", "vec"])

    return rows.mapInArrow(run, "id long, width int, vec binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def in_trees(rows: DataFrame) -> DataFrame:
    """rows(id, width, vec) with the name of the tree that each belongs to."""
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    block = min(BLOCK, max(LEAST_BLOCK, -(-n // (2 * cores))))
    sample = rows.select("width", "vec").orderBy(F.xxhash64("id", "vec"), "vec").limit(max(1, min(CENTRES, n // block))).collect()
    centres: dict[int, list] = {}
    for r in sample:
        centres.setdefault(r.width, []).append(np.frombuffer(r.vec, "<i8").astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, cell = batch.column(1).to_numpy(), np.full(batch.num_rows, -1, np.int32)
            for w, own in centres.items():
                here = np.flatnonzero(width == w)
                if len(here):
                    c = np.array(own)
                    cell[here] = ((c**2).sum(1) - 2 * _matrix(batch.column(2).take(pa.array(here)), w).astype(np.float64) @ c.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "width", "vec", "cell"])

    dealt = written(rows.mapInArrow(run, "id long, width int, vec binary, cell int"), "vector-cells")
    parts = dealt.groupBy("width", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(1), "id", "vec"), F.col("parts"))
    return dealt.join(parts, ["width", "cell"]).select("id", "width", "vec", F.concat_ws("/", "width", "cell", part).alias("tree"))


TREE = "tree string, width int, centre binary, radius double, most double, stored binary"


def built(rows: DataFrame) -> DataFrame:
    """A row for each tree of rows(id, width, vec, tree): its root entry and its pages."""

    def made(name: str, width: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        tree = MTree.build(rows.column("id").to_numpy(), np.concatenate([_matrix(c, width) for c in rows.column("vec").chunks]))
        centre, radius, most = tree.root()
        values = [[name], [width], [centre.tobytes()], [radius], [most], [tree.stored()]]
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in TREE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wide, held = None, 0, []
        for batch in batches:
            for name, part in _runs(batch, "tree"):
                if name != at and held:
                    yield made(at, wide, held)
                    held = []
                at, wide = name, part.column(part.schema.get_field_index("width"))[0].as_py()
                held.append(part)
        if held:
            yield made(at, wide, held)

    return rows.repartition("tree").sortWithinPartitions("tree").mapInArrow(run, TREE)


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Each run of rows of one value of a sorted column."""
    names = np.array(batch.column(batch.schema.get_field_index(column)).to_pylist(), dtype=object)
    begin = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(names)], strict=True):
        yield names[a], batch.slice(a, b - a)


def routes(asked: DataFrame, trees: DataFrame, n_asked: int, n_trees: int, first: bool) -> DataFrame:
    """asked(id, width, vec, floor, seen) with the tree that promises most (`first`, with its bound), or every tree but `seen` whose bound reaches the floor.

    Queries meet roots in blocks: a block of queries and one of roots are a task's work.
    """
    n_parts, n_blocks = max(1, -(-n_asked // QUERIES)), max(1, -(-n_trees // ROOTS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    roots = trees.select("tree", "width", "centre", "radius", "most", F.pmod(F.xxhash64("tree"), F.lit(n_blocks)).cast("int").alias("block"), spread(n_parts).alias("part"))
    asked = asked.select("id", "width", "vec", "floor", "seen", F.pmod(F.xxhash64("id", "vec"), F.lit(n_parts)).cast("int").alias("part"), spread(n_blocks).alias("block"))
    names = ["id", "width", "vec", "floor", "tree", "bound"]

    def meet(asked: pa.Table, roots: pa.Table) -> pa.Table:
        out = [pa.table({n: pa.array([], t) for n, t in zip(names, [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.float64()], strict=True)})]
        widths = np.intersect1d(asked.column("width").to_numpy(), roots.column("width").to_numpy())
        for width in widths.tolist():
            own, of = asked.filter(pa.compute.field("width") == width).combine_chunks(), roots.filter(pa.compute.field("width") == width).combine_chunks()
            centre = np.frombuffer(b"".join(of.column("centre").to_pylist()), np.float64).reshape(-1, width)
            bound = root_bounds(_matrix(own.column("vec"), width).astype(np.float64), centre, of.column("radius").to_numpy(), of.column("most").to_numpy())
            tree = np.array(of.column("tree").to_pylist(), dtype=object)
            if first:
                q, t = np.arange(len(bound)), bound.argmax(1)
            else:
                seen = np.array(own.column("seen").to_pylist(), dtype=object)
                q, t = np.nonzero((bound >= own.column("floor").to_numpy()[:, None]) & (tree != seen[:, None]))
            columns = [own.column(c).take(pa.array(q)) for c in names[:4]]
            out.append(pa.table([*columns, pa.array(tree[t].tolist(), pa.string()), pa.array(bound[q, t])], names=names))
        return pa.concat_tables(out)

    pairs = asked.groupBy("part", "block").cogroup(roots.groupBy("part", "block"))
    return pairs.applyInArrow(meet, "id long, width int, vec binary, floor long, tree string, bound double")


def searched(asked: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """asked(id, width, vec, floor, tree) with the vec_ids and scores of each query's best rows in its tree. Queries go to the trees."""
    none = lambda *kinds: [F.lit(None).cast(t) for t in kinds]
    stored = trees.select("tree", F.lit(0).alias("role"), "width", "stored", *none("long", "binary", "long"))
    rows = stored.union(asked.select("tree", F.lit(1), "width", F.lit(None).cast("binary"), "id", "vec", "floor")).toDF("tree", "role", "width", "stored", "id", "vec", "floor")
    rows = rows.repartition("tree").sortWithinPartitions("tree", "role")
    names = ["tree", "id", "vec", "vec_ids", "scores"]

    def answers(tree: MTree, name: str, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, vec = part.column(part.schema.get_field_index("id")), part.column(part.schema.get_field_index("vec"))
        floor = part.column(part.schema.get_field_index("floor")).to_numpy()
        scores, found = tree.search(_matrix(vec, tree.rows.shape[1]), ids.to_numpy(), k, floor)
        good = scores > NONE
        offsets = pa.array(np.append(0, np.cumsum(good.sum(1))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[good])) for x in (found, scores)]
        return pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows, pa.string()), ids, vec, *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, blob, tree = None, None, None
        for batch in batches:
            for here, part in _runs(batch, "tree"):
                if here != name:  # a tree's own row comes before its queries
                    name, blob, tree = here, part.column(part.schema.get_field_index("stored"))[0].as_py(), None
                    part = part.slice(1)
                for at in range(0, part.num_rows, QUERIES):
                    tree = tree or MTree.load(blob)
                    yield answers(tree, name, part.slice(at, QUERIES))

    return rows.mapInArrow(run, "tree string, id long, vec binary, vec_ids array<long>, scores array<long>")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, *, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows; `queries` is a condition on the column `id`."""
    rows = written(integers(vectors, id_column, column), "vectors")
    trees = written(built(in_trees(rows)), "vector-trees")
    asked = rows.filter(queries).select("id", "width", "vec").distinct()
    asked = written(asked.select("*", F.lit(NONE).cast("long").alias("floor"), F.lit(None).cast("string").alias("seen")), "vector-queries")
    sizes = asked.count(), trees.count()
    best = routes(asked, trees, *sizes, first=True).groupBy("id", "width", "vec").agg(F.max_by("tree", F.struct("bound", "tree")).alias("tree"))
    near = written(searched(best.withColumn("floor", F.lit(NONE).cast("long")), trees, k), "vector-first")
    floor = F.when(F.size("scores") == k, F.element_at("scores", k)).otherwise(F.lit(NONE).cast("long"))
    rest = near.select("id", (F.octet_length("vec") / 8).cast("int").alias("width"), "vec", floor.alias("floor"), F.col("tree").alias("seen"))
    far = searched(routes(rest, trees, *sizes, first=False).drop("bound"), trees, k)
    found = near.union(far).select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("vec_ids", "scores")).alias("hit"))
    found = found.select("query_id", F.col("hit.vec_ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10"""
