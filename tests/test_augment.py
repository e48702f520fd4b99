"""Degradations and blended fakes against plain loops; draws repeat and don't see labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import augment as A
from tidemark.operators import jpeg


def window(seed=0, shape=(5, 22, 30, 3)):
    return np.random.default_rng(seed).integers(0, 256, shape, np.uint8)


def mirrored(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def test_blurs_against_loops():
    x = window(1, (1, 9, 12, 3)).astype(float)
    for axis, k in ((1, A.gaussian(5)), (2, np.full(4, 0.25)), (2, A.gaussian(7))):
        got, n = A.along(x, axis, k), x.shape[axis]
        for i in range(n):
            want = sum(w * x.take(mirrored(i - (len(k) - 1) // 2 + j, n), axis) for j, w in enumerate(k))
            np.testing.assert_allclose(got.take(i, axis), want)
    assert A.gaussian(3) == pytest.approx([0.23899, 0.52201, 0.23899], abs=1e-4) and A.gaussian(15, 5.0).sum() == pytest.approx(1)


def test_resampling_against_loops():
    x = window(2, (1, 20, 3, 1)).astype(float)[0, :, 0, 0]
    for size, cubic in ((9, False), (47, True), (20, True)):
        got = A.resampled(x[None, :, None, None], 1, size, cubic)[0, :, 0, 0]
        for i in range(size):
            at = (i + 0.5) * len(x) / size - 0.5
            total = 0.0
            for j in range(int(np.floor(at)) - 1, int(np.floor(at)) + 3):
                d = abs(at - j)
                w = (max(0.0, 1 - d)) if not cubic else (1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0.0)
                total += w * x[min(max(j, 0), len(x) - 1)]
            assert got[i] == pytest.approx(total)
    assert (A.rescaled(np.full((2, 30, 40, 3), 91, np.uint8), 0.5) == 91).all()


def test_compression_is_what_a_file_leaves(spark, tmp_path):
    x = window(3)
    for q in (20, 90):
        for i, f in enumerate(x):
            (tmp_path / f"{q}-{i}.jpg").write_bytes(jpeg.encode(f, q))
    rows = spark.read.format("image").load(f"file://{tmp_path}").select("image.*").collect()
    for r in rows:
        q, i = map(int, r.origin.rsplit("/", 1)[-1].removesuffix(".jpg").split("-"))
        read = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, 3)[..., ::-1]
        assert np.abs(A.compressed(x, q)[i].astype(int) - read).max() <= 4


def test_tone_freezes_and_blends():
    x = window(4)
    none = dict.fromkeys(["rescale", "quality", "gauss", "motion", "contrast", "brightness", "noise", "freeze"]) | {"long_freeze": True, "seed": -5}
    assert (A.degraded(x, none) == x).all()
    frozen = A.degraded(x, none | {"freeze": 2})
    assert (frozen[2] == x[1]).all() and (frozen[3] == x[1]).all() and (frozen[[0, 1, 4]] == x[[0, 1, 4]]).all()
    assert (A.degraded(x, none | {"freeze": 2, "long_freeze": False})[3] == x[3]).all()
    dark = A.degraded(x, none | {"contrast": 0.5, "brightness": 3.0, "noise": 0.0})
    assert (dark == np.clip(x * 0.5 + 3, 0, 255).astype(np.uint8)).all()
    grain = A.toned(np.full((4, 60, 60, 3), 128, np.uint8), 1.0, 0.0, 10.0, 9).astype(float)
    assert abs(grain.std() - 10) < 0.5 and abs(grain.mean() - 127.5) < 0.5
    x = window(4, (2, 64, 80, 3))
    mask, fake = A.feathered(64, 80), A.blended(x, 1.2, -10.0)
    source = np.clip(x * 1.2 - 10, 0, 255).astype(np.uint8)
    outside = mask == 0
    assert outside.any() and (fake[:, outside] == x[:, outside]).all() and mask.max() <= 1 + 1e-9
    m = mask[None, :, :, None]
    assert (fake == np.where(m > 0, source * m + x * (1 - m), x).astype(np.uint8)).all() and (fake != x).any()


def test_draws_repeat_and_see_no_label(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 2 == 0).alias("fake"), F.lit(bytearray(window(6, (5, 16, 16, 3)).tobytes())).alias("rgb"), F.lit(5).alias("frames"), F.lit(16).alias("height"), F.lit(16).alias("width"))
    d = rows.select("id", "fake", A.draws(F.col("id"), F.col("frames")).alias("d")).select("id", "fake", "d.*").toPandas()
    for column, share in (("rescale", 0.51), ("quality", 0.595), ("contrast", 0.51), ("freeze", 0.2975)):
        by = d.groupby("fake")[column].apply(lambda v: v.notna().mean())
        assert abs(by[True] - share) < 0.04 and abs(by[False] - share) < 0.04
    assert d.quality.dropna().between(20, 90).all() and set(d.gauss.dropna()) == {3, 5, 7} and d.motion.dropna().between(3, 9).all() and d.freeze.dropna().between(1, 3).all()
    few = rows.filter("id < 40").withColumn("rgb", F.when(F.col("id") == 7, F.lit(None)).otherwise(F.col("rgb")))
    one, two = (sorted(map(tuple, A.augmented(r, ["id"]).select("id", F.sha2("degraded", 256), F.sha2("blended", 256)).collect())) for r in (few, few.repartition(3).withColumn("fake", ~F.col("fake"))))
    assert one == two and [r[0] for r in one if r[1] is None] == [7]
    x = window(6, (5, 16, 16, 3))
    got = {r.id: r for r in A.augmented(few, ["id"]).collect()}
    for i in (0, 3, 11):
        assert bytes(got[i].degraded) == A.degraded(x, got[i].asDict()).tobytes()
