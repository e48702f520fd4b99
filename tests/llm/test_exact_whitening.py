"""Stateful exact dedup and whitening against brute force on small fixtures."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact, whitening
from tidemark.llm.common import new_path

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "Word " * 40_000), (7, "Word " * 40_000), (None, "b"), (8, "b"), (8, "b"), (9, "lone"), (10, "a ")]


def brute(rows):
    """Sorted (doc_id, keep_id, group_size, text digest) and how many rows stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    return sorted((i, max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), len(groups)


def found(df):
    rows = df.collect()
    kept = [r for r in rows if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len({r.text_sha256 for r in kept}) == len(kept)
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in rows), len(kept)


def stored(spark, rows, tmp_path, parts=3):
    path = str(tmp_path / "documents.parquet")
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("held", F.lit("x")).withColumn("n", F.lit(2))
    frame.repartition(parts).write.parquet(path)
    return path


@pytest.mark.parametrize("bytes_a_batch", [1, exact.BYTES_A_BATCH])
def test_exact_in_batches_of_files(spark, tmp_path, bytes_a_batch):
    path, checkpoint = stored(spark, ROWS, tmp_path), new_path(spark, "test")
    exact.absorb(spark, path, checkpoint, bytes_a_batch=bytes_a_batch)
    assert found(exact.deduplicated(spark, path, checkpoint)) == brute(ROWS)


def test_exact_goes_on_with_its_state(spark, tmp_path):
    path, checkpoint = stored(spark, ROWS[:5], tmp_path), new_path(spark, "test")
    exact.absorb(spark, path, checkpoint)
    spark.createDataFrame(ROWS[5:], "doc_id long, text string").write.mode("append").parquet(path)
    exact.absorb(spark, path, checkpoint)
    exact.absorb(spark, path, checkpoint)  # nothing new
    assert exact.state_of(spark, checkpoint).agg(F.sum("n")).first()[0] == len(ROWS)
    assert found(exact.deduplicated(spark, path, checkpoint)) == brute(ROWS)


def test_exact_compares_bytes_on_hits(spark, tmp_path):
    # A digest that all texts of one length share.
    weak = lambda t: F.unhex(F.format_string("%04X", F.length(t)))
    rows = [*ROWS, (20, "c"), (21, "c"), (22, "d"), (23, "once")]
    path, checkpoint = stored(spark, rows, tmp_path), new_path(spark, "test")
    exact.absorb(spark, path, checkpoint, digest=weak)
    assert exact.confirmed(exact.rows_of(spark.read.parquet(path), weak), exact.state_of(spark, checkpoint)).filter("not sound").count() >= 4
    assert found(exact.deduplicated(spark, path, checkpoint, digest=weak)) == brute(rows)


def test_exact_on_a_shuffle_of_hits_and_on_no_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_HITS", 0)
    path, checkpoint = stored(spark, ROWS, tmp_path), new_path(spark, "test")
    exact.absorb(spark, path, checkpoint)
    assert found(exact.deduplicated(spark, path, checkpoint)) == brute(ROWS)
    empty = stored(spark, [], tmp_path / "none", 1)
    exact.absorb(spark, empty, other := new_path(spark, "test"))
    assert exact.deduplicated(spark, empty, other).count() == 0


def embedded(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit("clash")).withColumn("n", F.lit(1))


def whitened(spark, vectors, components=32):
    return whitening.whiten(whitening.usable(embedded(spark, vectors)), components).toPandas()


def reference(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    deviations = len(x) * x - x.sum(0)
    centred = deviations / len(x)
    values, basis = np.linalg.eigh(centred.T @ centred / len(x))
    return deviations, centred, values[::-1], basis[:, ::-1]


@pytest.mark.parametrize(("rows", "width", "rank"), [(300, 24, 24), (200, 90, 90), (60, 40, 5), (12, 40, 11)])
def test_whitening_against_eigh(spark, rows, width, rank):
    draw = np.random.default_rng(rows)
    vectors = (draw.standard_normal((rows, width)) * np.linspace(1, 4, width)).round(2)
    if rank < min(rows - 1, width):  # whole numbers, so that the rank survives the floor
        vectors = draw.integers(-3, 4, (rows, rank)) @ draw.integers(-2, 3, (rank, width))
    got = whitened(spark, list(vectors))
    deviations, centred, values, basis = reference(vectors)
    k = min(32, rank)
    assert got.component.max() == k and len(got) == rows * k
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    np.testing.assert_allclose(np.abs(table), np.abs(centred @ basis[:, :k] / np.sqrt(values[:k])), atol=1e-8)
    np.testing.assert_allclose(got[got.vec_id == 0].sort_values("component").explained, values[:k] / values.sum(), rtol=1e-9)
    assert (got.drop_duplicates("vec_id").sort_values("vec_id").deviation.to_numpy() == (deviations**2).sum(1)).all()
    assert got.identity_error.max() < 1e-10 and set(got.n) == {rows}


def test_whitening_of_odd_rows(spark):
    draw = np.random.default_rng(1)
    good = draw.standard_normal((20, 3)).round(2).tolist()
    odd = [None, [1, None, 2], [float("nan"), 0, 0], [float("inf"), 0, 0], [1, 2], []]
    got = whitened(spark, good + odd)
    assert set(got.vec_id) == set(range(20)) and set(got.n) == {20}
    assert whitened(spark, []).empty and whitened(spark, odd[:4]).empty
    assert whitened(spark, [[1, 2, 3]]).empty and whitened(spark, [[1, 2, 3]] * 4).empty  # no variance
    two = whitened(spark, [[0, 0], [1, 0], [0, 0], [1, 0]])
    assert set(two.component) == {1} and sorted(two.whitened.round(9)) == [-1, -1, 1, 1]


def test_whitening_of_huge_entries(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [1e12, 3.0]]
    got = whitened(spark, vectors)
    assert got.deviation.isna().all() and got.identity_error.max() < 1e-4
    few = whitened(spark, [[1e9, 0], [0, 1e9], [5, 5]])  # n * x fits a long, its square doesn't
    assert few.deviation.isna().any() and few.identity_error.max() < 1e-4


def test_lanczos_restarts_and_compresses():
    draw = np.random.default_rng(5)
    q, _ = np.linalg.qr(draw.standard_normal((120, 120)))
    for values in (np.r_[[9.0] * 7, [4.0] * 5, [1.0] * 3, np.zeros(105)], np.linspace(1, 3, 120), np.r_[50, 40, 30, np.linspace(0, 1, 117)]):
        matrix, passes = (q * values) @ q.T, []
        got, vectors = whitening.lanczos(lambda b, m=matrix, p=passes: (p.append(1), m @ b)[1], 120, 6, block=4, tolerance=1e-12)
        np.testing.assert_allclose(got, np.sort(values)[::-1][:6], atol=1e-9)
        assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-12
        assert np.linalg.norm(matrix @ vectors - vectors * got) < 1e-9
