"""JPEG files against a decoder that isn't ours: Spark's picture source, which is Java's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import jpeg


def decoded(spark, folder):
    rows = spark.read.format("image").load(folder).select("image.*").collect()
    return {r.origin.rsplit("/", 1)[-1]: np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)[..., ::-1] for r in rows}


def pictures():
    r = np.random.default_rng(0)
    y, x = np.mgrid[:61, :83]
    smooth = np.stack([128 + 90 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), (x + y) * 255 / 144], -1).astype(np.uint8)
    return {
        "smooth": smooth, "noise": r.integers(0, 256, (40, 24, 3), np.uint8), "flat": np.full((16, 16, 3), 77, np.uint8), "dot": np.array([[[200, 10, 90]]], np.uint8),
        "lines": np.where((x // 3 + y // 5)[..., None] % 2 == 0, 255, 0).repeat(3, 2).astype(np.uint8), "black": np.zeros((8, 9, 3), np.uint8),
    }


def requantised(p, quality):
    """What is left of a picture after its coefficients are rounded to multiples of the divisors, block by block in loops."""
    cosines = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    h, w = p.shape[:2]
    planes = jpeg.components(p)
    out = np.zeros((3, h, w))
    for i, plane in enumerate(planes):
        divisors = jpeg.tables(quality)[min(i, 1)].reshape(8, 8)
        for y in range(0, h, 8):
            for x in range(0, w, 8):
                block = plane[np.ix_(np.minimum(range(y, y + 8), h - 1), np.minimum(range(x, x + 8), w - 1))]
                kept = np.rint(cosines @ block @ cosines.T / divisors) * divisors
                out[i, y : y + 8, x : x + 8] = (cosines.T @ kept @ cosines)[: h - y, : w - x]
    out = np.clip(np.rint(out + 128), 0, 255)  # planes are bytes before colours come of them
    luma, blue, red = out[0], out[1] - 128, out[2] - 128
    return np.clip(np.stack([luma + 1.402 * red, luma - 0.344136 * blue - 0.714136 * red, luma + 1.772 * blue], -1), 0, 255)


@pytest.mark.parametrize("quality", [100, 95, 50, 10])
def test_another_decoder_reads_the_files(spark, tmp_path, quality):
    made = pictures()
    for name, p in made.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(p, quality))
    got = decoded(spark, f"file://{tmp_path}")
    for name, p in made.items():
        # A decoder in whole numbers may be off by a few steps of brightness.
        assert got[f"{name}.jpg"].shape == p.shape and np.abs(got[f"{name}.jpg"] - requantised(p, quality)).max() <= 4, name
        if quality >= 95 and name in ("smooth", "flat", "black"):
            assert np.abs(got[f"{name}.jpg"].astype(int) - p.astype(int)).mean() < 2.5


def test_codes_stay_within_sixteen_bits():
    from collections import Counter

    counts = Counter({s: 2**s for s in range(30)})
    lengths = jpeg.code_lengths(counts)
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) <= 1 - 2.0**-16
    coded = jpeg.codes(lengths)
    words = sorted(f"{c:0{n}b}" for c, n in coded.values())
    assert all(not b.startswith(a) for a, b in zip(words, words[1:])) and not any(set(w) == {"1"} for w in words)
    assert jpeg.code_lengths(Counter({5: 1})) == {5: 1}


def test_evidence_files(spark, tmp_path):
    p = pictures()
    rows = spark.createDataFrame([(f"s1/evidence/{k}.jpg", bytearray(v.tobytes()), v.shape[0], v.shape[1]) for k, v in p.items()] + [("s2/none.jpg", None, 8, 8), ("s2/short.jpg", bytearray(b"x"), 8, 8)], "name string, pixels binary, h int, w int")
    files = jpeg.jpeg(rows.repartition(3), "pixels", "h", "w")
    for _ in range(2):  # a second attempt writes the same files
        found = {r.name: r.size for r in jpeg.write_files(files, "name", "jpeg", f"file://{tmp_path}/cases").collect()}
    assert set(found) == {f"s1/evidence/{k}.jpg" for k in p} and not (tmp_path / "cases/s2").exists()
    assert sorted(f.name for f in (tmp_path / "cases/s1/evidence").iterdir()) == sorted(f"{k}.jpg" for k in p)
    assert all((tmp_path / "cases" / n).stat().st_size == size for n, size in found.items())
    assert files.filter(F.col("jpeg").isNull()).count() == 2


def test_evidence_of_pages(spark, sf_dir):
    import hashlib

    import __spark_entry__ as entry
    from tidemark.operators import tensors
    from tidemark.plans import signal_queries

    got = {(r.page_id, r.window): r for r in entry.queries()["evidence_files"](spark, sf_dir).collect()}
    rows = signal_queries.page_pictures(spark, sf_dir).collect()
    assert len(got) == len(rows) > 40
    for r in rows:
        data = jpeg.encode(tensors.heat_map(np.frombuffer(bytes(r.rgb), np.uint8).reshape(4, 64, 64, 3)[2]))
        x = got[r.page_id, r.window]
        assert (x.size, x.digest, x.name) == (len(data), hashlib.sha256(data).hexdigest(), f"{r.page_id}/evidence/heatmap_w{r.window:03d}.jpg")
