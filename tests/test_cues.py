"""Cues of many windows at a time against one picture after another, by whole spectra, convolutions and all lines."""

import time

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import lines, pixels


def laplacian_variance(a):
    n = np.pad(a.astype(float), 1, mode="reflect")
    return (n[:-2, 1:-1] + n[2:, 1:-1] + n[1:-1, :-2] + n[1:-1, 2:] - 4 * n[1:-1, 1:-1]).var()


def plain_moire(g):
    h, w = g.shape
    if min(h, w) < 32:
        return 0.0
    size = np.log(np.abs(np.fft.fftshift(np.fft.fft2(g))) + 1.0)
    reach = np.hypot(*np.meshgrid(np.arange(w) - w // 2, np.arange(h) - h // 2)) / min(h // 2, w // 2)
    band = size[(reach > 0.25) & (reach < 0.85)]
    return (band.max() - band.mean()) / (band.std() + 1e-6)


def plain_chroma(rgb):
    y, vary = pixels.grey(rgb), laplacian_variance(pixels.grey(rgb))
    if min(y.shape) < 32 or vary < 5.0:
        return 0.0
    red, blue = (np.rint(np.clip((rgb[..., k].astype(float) - y) * by + 128, 0, 255)) for k, by in ((0, 0.713), (2, 0.564)))
    return (laplacian_variance(red) + laplacian_variance(blue)) / (2 * vary)


def plain_liveness(greys):
    used = [g for g in greys if g.max() > 10]
    if len(used) < 4:
        return 5.0, 5.0, 0.0, 0.5
    k = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 1.2**2))
    along = lambda a, axis: np.apply_along_axis(np.convolve, axis, a, k / k.sum(), "valid")
    smooth = [along(along(np.pad(g, 2, mode="reflect"), 1), 0) for g in used]
    base, (h, w) = smooth[0], smooth[0].shape
    inner = np.s_[int(h * 0.15) : int(h * 0.85), int(w * 0.15) : int(w * 0.85)]
    eyes = np.s_[int(h * 0.20) : int(h * 0.52), int(w * 0.15) : int(w * 0.85)]
    rest, eye, shifts, alike = [], [], [], []
    for g in smooth[1:]:
        cross = np.fft.fft2(g) * np.fft.fft2(base).conj()
        peak = np.unravel_index(np.fft.ifft2(cross / (np.abs(cross) + 1e-9)).real.argmax(), (h, w))
        dy, dx = ((p + n // 2) % n - n // 2 for p, n in zip(peak, (h, w)))
        back = np.pad(g, ((abs(dy), abs(dy)), (abs(dx), abs(dx))), mode="symmetric")[abs(dy) + dy :, abs(dx) + dx :][:h, :w]
        shifts.append(np.hypot(dx, dy))
        rest.append(np.abs(back - base)[inner].mean())
        eye.append(np.abs(back - base)[eyes].mean())
        if min(base[inner].std(), back[inner].std()) > 1e-4:
            alike.append(np.corrcoef(base[inner].ravel(), back[inner].ravel())[0, 1])
    return np.mean(rest), max(eye), np.mean(shifts), np.mean(alike) if alike else 0.9


def plain_bezel(grey, box):
    """All lines, whether or not they could be a frame's."""
    if box is None or min(box[2:]) < 20:
        return 0.0
    (x, y, w, h), (rows, columns) = box, grey.shape
    x0, y0, x1, y1 = max(0, x - int(w * 0.45)), max(0, y - int(h * 0.45)), min(columns, x + w + int(w * 0.45)), min(rows, y + h + int(h * 0.45))
    if min(x1 - x0, y1 - y0) < 30:
        return 0.0
    edge = lines.edges(grey[y0:y1, x0:x1])
    edge[max(0, y - y0 + int(h * 0.15)) : max(0, y - y0 + int(h * 0.85)), max(0, x - x0 + int(w * 0.15)) : max(0, x - x0 + int(w * 0.85))] = False
    return lines.frame_score(edge)


def plain_cues(rgb, box):
    greys = [pixels.grey(x) for x in rgb[:16]]
    spot = max(pixels.glare(x, g) for x, g in zip(rgb, greys))
    lit = spot >= pixels.GLARE
    bright = (max(map(pixels.planar, greys)), np.mean(list(map(pixels.veiling, greys))), pixels.decoupling(greys) if len(greys) >= 3 else 0.0) if lit else (0.0, 0.0, 0.0)
    frame = max(plain_bezel(g, box) for g in greys[:8])
    return [np.mean(list(map(plain_moire, greys))), np.mean(list(map(plain_chroma, rgb[:16]))), spot, *bright[:2], frame, bright[2], *plain_liveness(greys), np.mean(list(map(laplacian_variance, greys))), np.mean(greys)]


def windows(n, frames, height, width, seed=0):
    """Noise, repeated texts, flat, dark, shifted, striped and bright pictures."""
    r = np.random.default_rng(seed)
    shape = (frames, height, width, 3)
    out = []
    for i in range(n):
        kind = i % 8
        rgb = r.integers(32, 123, shape)
        if kind == 1:  # a text repeated, each row of a picture a little further on
            rgb = np.resize(r.integers(32, 123, 3 * width + 5 * int(r.integers(1, 9))), shape)
        elif kind == 2:
            rgb[:] = r.integers(0, 256)
        elif kind == 3:
            rgb[r.random(frames) < 0.4] //= 13
        elif kind == 4:
            rgb = np.stack([np.roll(rgb[0], (k, -2 * k), (0, 1)) for k in range(frames)])
        elif kind == 5:
            rgb[:, :, width // 8 : width // 8 + 2] = 250
            rgb[:, height // 9 * 8] = 250
        elif kind == 6:
            rgb[:, 5:15, 5:15] = r.integers(230, 256, (10, 10, 1))
            rgb[:, 15:17, 5:15] = 20
        elif kind == 7:
            rgb = np.broadcast_to(np.arange(width)[:, None] * 5 % 256, shape)
        out.append(rgb)
    return np.stack(out).astype(np.uint8)


@pytest.mark.parametrize("shape", [(4, 64, 64), (5, 65, 70), (1, 40, 33), (18, 32, 48), (4, 20, 31)])
def test_cues_against_single_pictures(shape):
    rgb = windows(24, *shape)
    boxes = [None if i % 5 == 4 else (4 + i % 5, 6, shape[2] * 5 // 9, shape[1] * 5 // 9) for i in range(len(rgb))]
    got, want = pixels.cues(rgb, boxes), np.array([plain_cues(x, box) for x, box in zip(rgb, boxes)])
    assert got.shape == (24, len(pixels.CUES))
    for k, name in enumerate(pixels.CUES):
        # The spectrum of a flat picture is rounding alone, over 1e-6.
        assert got[:, k] == pytest.approx(want[:, k], abs=1e-4 if name == "moire" else 1e-9, rel=1e-12), name
    if shape == (4, 64, 64):
        assert (got[:, pixels.CUES.index("bezel")] > 0).any() and (got[:, pixels.CUES.index("glare")] >= pixels.GLARE).any()


@pytest.mark.parametrize("size", [(40, 64, 64), (20, 100, 70), (6, 150, 170)])
def test_frames_are_not_missed(size):
    """Sparse and dense pictures, with lines of many angles and lengths: those passed over have no frame."""
    r = np.random.default_rng(size[1])
    greys = np.full(size, 90.0)
    for g in greys:
        g += np.rint(r.random(g.shape) * r.choice([0, 40, 130]))
        for _ in range(r.integers(0, 5)):
            angle, at, t = r.choice([0, 90, 90 + r.integers(-20, 20), r.integers(-20, 20), r.integers(0, 180)]), r.random(2) * size[1:], np.arange(-120, 120, 0.5)
            t = t[(t > -r.integers(10, 120)) & (t < r.integers(10, 120))]
            y, x = np.rint(at[:, None] + np.outer((np.sin(np.deg2rad(angle)), np.cos(np.deg2rad(angle))), t)).astype(int)
            inside = (y >= 0) & (x >= 0) & (y < size[1]) & (x < size[2])
            g[y[inside], x[inside]] = 250
    boxes = [(size[2] // 4, size[1] // 4, size[2] // 2, size[1] // 2)] * size[0]
    got = lines.bezels(greys, boxes)
    assert got.tolist() == [plain_bezel(g, box) for g, box in zip(greys, boxes)] and 0 < (got > 0).sum() < len(got)
    assert (lines.bezels(greys.astype(np.int16), boxes) == got).all()


def test_many_windows_in_few_steps():
    """A window costs a fraction of what it costs alone with spectra, convolutions and lines of its own."""
    rgb, boxes = np.random.default_rng(0).integers(32, 123, (128, 4, 64, 64, 3), np.uint8), [(12, 12, 36, 36)] * 128
    pixels.cues(rgb[:64], boxes[:64])

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    whole = min(seconds(lambda: pixels.cues(rgb, boxes)) for _ in range(3)) / 128
    assert 3 * whole < seconds(lambda: [plain_cues(x, box) for x, box in zip(rgb[:8], boxes)]) / 8


def test_short_blocks(spark):
    """A block shorter than its window is repeated, or malformed; others have no cues."""
    r = np.random.default_rng(0)
    block = r.integers(32, 123, 4 * 32 * 32 * 3, np.uint8).tobytes()
    rows = [(0, bytearray(block[:1000]), 4, 32, 32), (1, bytearray(np.resize(np.frombuffer(block[:1000], np.uint8), len(block)).tobytes()), 4, 32, 32), (2, None, 4, 32, 32), (3, bytearray(block + b"x"), 4, 32, 32), (4, bytearray(), 4, 32, 32), (5, bytearray(block), None, 32, 32), (6, bytearray(block[: 2 * 32 * 48 * 3]), 2, 32, 48)]
    frame = spark.createDataFrame(rows, "id int, rgb binary, frames int, height int, width int")
    cues = {n: {r.id: r[1:] for r in pixels.picture_cues(frame, ["id"], repeated=n).collect()} for n in (True, False)}
    assert [k for k, v in sorted(cues[True].items()) if v[0] is None] == [2, 3, 4, 5] and [k for k, v in sorted(cues[False].items()) if v[0] is None] == [0, 2, 3, 4, 5]
    assert cues[True][0] == cues[True][1] == cues[False][1] and cues[True][6] == cues[False][6]
    assert all(v is None or not pd.isna(v) for row in cues[True].values() for v in row)


def test_one_file_is_dealt_to_all_cores(spark, sf_dir):
    """Windows of pages in one small file aren't one task's."""
    from pyspark.sql import functions as F

    from tidemark.plans import signal_queries as Q

    counts = [r["count"] for r in Q.page_pictures(spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) >= spark.sparkContext.defaultParallelism and max(counts) < sum(counts) / 2


def test_texts_repeated_as_windows(spark):
    """Windows with each text there once, repeated by numpy, are the windows themselves."""
    size = 2 * 4 * 4 * 3
    texts = ["x", "é" * size, "abc" * 100, "a" * size, "bé" * size, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    short, whole = ({(r.id, r.window): bytes(r.rgb) for r in f(rows, "t", 2, 4).collect()} for f in (pixels.cut_windows, pixels.windows_of))
    assert short.keys() == whole.keys() and len(short[0, 0]) == 1
    assert {k: np.resize(np.frombuffer(v, np.uint8), size).tobytes() for k, v in short.items()} == whole
