"""Lines, frames of devices, and pictures cut from a table, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lines


def plain_edges(grey, weak=60.0, strong=180.0):
    h, w = grey.shape
    g = lambda y, x: float(grey[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    gx, gy = np.zeros((h, w)), np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            for d, k in ((-1, 1), (0, 2), (1, 1)):
                gx[y, x] += k * (g(y + d, x + 1) - g(y + d, x - 1))
                gy[y, x] += k * (g(y + 1, x + d) - g(y - 1, x + d))
    size = abs(gx) + abs(gy)
    ridge = set()
    for y in range(h):
        for x in range(w):
            a, b = abs(gx[y, x]), abs(gy[y, x])
            if b <= a * math.tan(math.pi / 8):
                step = (0, 1)
            elif b >= a * math.tan(3 * math.pi / 8):
                step = (1, 0)
            else:
                step = (1, 1) if gx[y, x] * gy[y, x] > 0 else (1, -1)
            s = lambda dy, dx: size[y + dy, x + dx] if 0 <= y + dy < h and 0 <= x + dx < w else 0.0  # noqa: B023, E731
            if size[y, x] > weak and size[y, x] > s(-step[0], -step[1]) and size[y, x] >= s(*step):
                ridge.add((y, x))
    todo = [p for p in ridge if size[p] > strong]
    found = set(todo)
    while todo:
        y, x = todo.pop()
        for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if p in ridge and p not in found:
                found.add(p)
                todo.append(p)
    out = np.zeros((h, w), bool)
    for p in found:
        out[p] = True
    return out


def plain_segments(edge, least, votes=40, gap=10):
    points = [(x, y) for y, x in zip(*np.nonzero(edge))]
    passed, found = set(), []
    angles = [math.pi * a / 180 for a in range(180)]
    rho = {p: [int(np.rint(p[0] * np.cos(np.deg2rad(a)) + p[1] * np.sin(np.deg2rad(a)))) for a in range(180)] for p in points}
    while True:
        count = {}
        for p in points:
            for a in range(180):
                if (a, rho[p][a]) not in passed:
                    count[a, rho[p][a]] = count.get((a, rho[p][a]), 0) + 1
        if not count or max(count.values()) < votes:
            return found
        a, r = min((-n, k) for k, n in count.items())[1]
        on = sorted((p for p in points if rho[p][a] == r), key=lambda p: p[1] * math.cos(angles[a]) - p[0] * math.sin(angles[a]))
        groups = [[on[0]]]
        for p, q in zip(on, on[1:]):
            step = (q[1] - p[1]) * math.cos(angles[a]) - (q[0] - p[0]) * math.sin(angles[a])
            if step > gap + 1:
                groups.append([])
            groups[-1].append(q)
        long = [g for g in groups if math.dist(g[0], g[-1]) >= least]
        if not long:
            passed.add((a, r))
        for g in long:
            found.append((*g[0], *g[-1]))
            points = [p for p in points if p not in set(g)]


def drawn(seed):
    r = np.random.default_rng(seed)
    picture = np.rint(90 + 20 * r.random((64, 64)))
    for _ in range(seed % 5):
        at, thick = r.integers(4, 56), r.integers(1, 8)
        if r.random() < 0.5:
            picture[:, at : at + thick] = r.integers(0, 256)
        else:
            picture[at : at + thick] = r.integers(0, 256)
    if seed % 3 == 0:
        for i in range(60):
            picture[i, max(0, i - 1) : i + 2] = 250
    return picture


@pytest.mark.parametrize("seed", range(8))
def test_lines_against_loops(seed):
    picture = drawn(seed)
    edge = lines.edges(picture)
    assert (edge == plain_edges(picture)).all()
    assert lines.segments(edge, 20) == plain_segments(edge, 20)


BOX = (22, 22, 40, 40)


def scene(*bars):
    picture = np.full((84, 84), 90.0)
    for upright, at in bars:
        picture[(slice(None), slice(at, None)) if upright else (slice(at, None), slice(None))] += 60
    return picture


def test_frames_of_devices():
    assert lines.bezel(scene(), BOX) == 0
    assert lines.bezel(scene((True, 12)), BOX) == 0  # one line alone
    assert lines.bezel(scene((True, 12), (True, 74)), BOX) == pytest.approx(0.50)
    assert lines.bezel(scene((False, 12), (False, 74)), BOX) == pytest.approx(0.50)
    assert lines.bezel(scene((True, 12), (False, 74)), BOX) >= 0.70
    assert lines.bezel(scene((True, 12), (True, 74)), None) == 0
    assert lines.bezel(scene((True, 12), (True, 74)), (22, 22, 19, 40)) == 0
    assert lines.bezel(scene((True, 12), (True, 74))[:26, :], (22, 2, 40, 20)) == 0  # too little around it
    inner = np.full((84, 84), 90.0)
    inner[34:50, 34:50] = 250  # within the face
    assert lines.bezel(inner, BOX) == 0


def test_windows_hold_all_bytes(spark):
    from tidemark.operators import pixels

    size = 2 * 4 * 4 * 3
    texts = ["x", "é" * size, "abc" * 100, "a" * size, "b" * (size + 1), "", None]
    rows = pixels.windows_of(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", 2, 4).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.window)):
        assert len(r.rgb) == size and (r.frames, r.height, r.width) == (2, 4, 4)
        got[r.id] = got.get(r.id, b"") + bytes(r.rgb)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        n = -(-len(raw) // size) * size
        assert got.get(i, b"") == (raw * (n // max(len(raw), 1) + 1))[:n]


def plain_replay(m, c, g, p, b, d):
    """Score and flags of a screen from ramped cues, as nested rules."""
    lit = g >= 0.35
    p, d, b = (p if lit else 0), (d if lit else 0), (b if lit or m >= 0.35 or c >= 0.35 else 0)
    pattern = m >= 0.40 or c >= 0.40
    display = pattern or (b >= 0.40 and (p >= 0.35 or d >= 0.35)) or (d >= 0.35 and (lit or p >= 0.35))
    score, flags = 0.0, []
    if lit and display:
        score = 0.40 * g + 0.35 * max(d, p) + 0.25 * max(m, c, b)
        flags.append("SPECULAR_SCREEN_GLARE")
    elif pattern and (b >= 0.40 or d >= 0.35):
        score = 0.50 * max(m, c) + 0.35 * max(b, d) + 0.20
    elif pattern:
        score = 0.80 * max(m, c)
    elif b >= 0.40 and d >= 0.35:
        score = 0.5 * b + 0.5 * d
    score = min(score, 1.0)
    flags += ["REFLECTION_MOTION_DECOUPLED"] * (d >= 0.35 and display) + ["PLANAR_SCREEN_REFLECTION"] * (p >= 0.35 and display) + ["MOIRE_PATTERN_DETECTED"] * (m >= 0.40)
    flags += ["SUBPIXEL_LATTICE_DETECTED"] * (c >= 0.40) + ["DEVICE_BEZEL_DETECTED"] * (b >= 0.40) + ["SCREEN_REPLAY_DETECTED"] * (score >= 0.65)
    return score, flags


def test_replay_flags(spark):
    import itertools

    from tidemark.operators import pixels

    grid = [(i, *v) for i, v in enumerate(itertools.product((0.0, 0.37, 0.6), (0.0, 0.5), (0.2, 0.9), (0.1, 0.8), (0.0, 0.5), (0.0, 0.36, 0.9)))]
    frame = spark.createDataFrame(grid, "id int, m double, c double, glare double, planar double, bezel double, decoupling double")
    rows = frame.withColumn("moire", 4.4 + 1.8 * F.col("m")).withColumn("chroma", 0.28 + 0.35 * F.col("c")).withColumn("r", pixels.replay()).select("id", "r.*").collect()
    for r in rows:
        score, flags = plain_replay(*grid[r.id][1:])
        assert r.replay_score == pytest.approx(score) and r.flags == flags
    assert {f for r in rows for f in r.flags} >= {"DEVICE_BEZEL_DETECTED", "SCREEN_REPLAY_DETECTED", "PLANAR_SCREEN_REFLECTION"}


def test_frames_against_slices(spark):
    from tidemark.operators import preprocess as PP

    r = np.random.default_rng(0)
    rgb = r.integers(0, 256, (3, 50, 60, 3), np.uint8)
    boxes = [(10, 5, 20, 24), None, (50, 40, 30, 30), (-5, -5, 12, 12), (70, 60, 5, 5)]
    rows = [(i, bytearray(rgb.tobytes()), 3, 50, 60, b) for i, b in enumerate(boxes)] + [(9, bytearray(b"short"), 3, 50, 60, None), (10, None, 3, 50, 60, None)]
    frame = spark.createDataFrame(rows, "id int, rgb binary, frames int, height int, width int, box struct<x:int,y:int,w:int,h:int>")
    got = {(x.id, x.frame): x for x in PP.preprocessed(frame, ["id"], 16).collect()}
    assert set(got) == {(i, f) for i in range(5) for f in range(3)}

    def colour(patch):
        if not patch.size:
            return (0.333, 0.333, 128.0, 128.0, 128.0)
        m = patch.reshape(-1, 3).mean(0)
        return (m[0] / (m.sum() + 1e-6), m[1] / (m.sum() + 1e-6), *m)

    at = lambda y0, y1, x0, x1: (slice(max(y0, 0), max(y1, 0)), slice(max(x0, 0), max(x1, 0)))
    for (i, f), x in got.items():
        picture, box = rgb[f].astype(float), boxes[i]
        face = neck = picture
        if box:
            bx, by, bw, bh = box
            face = picture[at(by + int(bh * 0.3), by + int(bh * 0.7), bx + int(bw * 0.3), bx + int(bw * 0.7))]
            top = min(49, by + bh + int(bh * 0.05))
            neck = picture[at(top, top + min(50 - top, int(bh * 0.25)), bx + int(bw * 0.25), bx + int(bw * 0.75))]
        assert tuple(x.face) == pytest.approx(colour(face)) and tuple(x.neck) == pytest.approx(colour(neck)) and tuple(x.background) == pytest.approx(colour(picture[:10, :12]))
        y = np.rint(picture @ (0.299, 0.587, 0.114))
        assert x.brightness == pytest.approx(y.mean()) and x.blur > 0 and len(x.crop) == 16 * 16 * 3
    flat = PP.resized(np.full((7, 9, 3), 40, np.uint8), 16)
    assert (flat == 40).all()
    ramp = np.repeat(np.arange(0, 160, 10, dtype=np.uint8)[:, None, None], 3, 2).repeat(4, 1)
    assert (PP.resized(ramp, 16)[:, 0, 0] == ramp[:, 0, 0]).all() and (np.diff(PP.resized(ramp, 40)[:, 0, 0].astype(int)) >= 0).all()
