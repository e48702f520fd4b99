"""Straight lines in grey pictures: thin edges by hysteresis, a Hough accumulator, and segments taken from it one by one."""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np

#: Gradients (|gx| + |gy|) from which an edge starts, and on which it goes on.
STRONG, WEAK = 180.0, 60.0
#: Votes a line needs, and missing pixels that a segment bridges.
VOTES, GAP = 40, 10
ANGLES = np.deg2rad(np.arange(180))
COS, SIN = np.cos(ANGLES), np.sin(ANGLES)
#: A segment of a frame is less than so many pixels off level or upright.
SLANT = 6

#: Pictures of up to so many pixels have a table of their votes' places.
TABLED = 1 << 13
#: Lines that are held against each other before all lines are taken one by one.
FEW = 8
#: Pictures whose edges are found in the same numpy steps.
AT_ONCE = 32
#: Pictures whose votes are added side by side come in multiples of so many.
LANES = 64

Box = tuple[int, int, int, int]


def bordered(pictures: np.ndarray, kind: type, mirror: int) -> np.ndarray:
    """Pictures of two pixels a side at least, with one more on each side: that at the edge, or with `mirror` 1 that before it."""
    n, h, w = pictures.shape
    out = np.empty((n, h + 2, w + 2), kind)
    out[:, 1:-1, 1:-1] = pictures
    out[:, 0], out[:, -1] = out[:, 1 + mirror], out[:, -2 - mirror]
    out[:, :, 0], out[:, :, -1] = out[:, :, 1 + mirror], out[:, :, -2 - mirror]
    return out


def linked_ridges(ridge: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Pixels of ridges that are strong or linked, pixel by pixel, to strong ones; of many pictures.

    64 pixels of a row are the bits of a number, so that a step outwards takes a few operations on these.
    """
    n, h, w = ridge.shape
    wide = np.zeros((2, n, h, -(-w // 64) * 64), bool)
    wide[0, :, :, :w], wide[1, :, :, :w] = ridge, strong
    within, now = np.packbits(wide, axis=-1, bitorder="little").view("<u8")
    one, last = np.uint64(1), np.uint64(63)
    while True:
        rows = now | now << one | now >> one
        rows[..., 1:] |= now[..., :-1] >> last
        rows[..., :-1] |= now[..., 1:] << last
        more = rows.copy()
        more[:, 1:] |= rows[:, :-1]
        more[:, :-1] |= rows[:, 1:]
        more &= within
        if (more == now).all():
            return np.unpackbits(now.view(np.uint8), axis=-1, count=w, bitorder="little").view(bool)
        now = more


def edges(grey: np.ndarray, weak: float = WEAK, strong: float = STRONG) -> np.ndarray:
    """Pixels on ridges of the gradient that are strong or linked, pixel by pixel, to strong ones, of a picture or many of one size.

    Beyond the border a picture goes on as it is, and has no gradient. Levels of an integer type are taken to be 0 to 255, for which
    single precision tells the same directions as double; others are worked on as doubles.
    """
    h, w = grey.shape[-2:]
    kind, real = (np.int16, np.float32) if np.issubdtype(grey.dtype, np.integer) else (np.float64, np.float64)
    pictures = bordered(grey.reshape(-1, h, w), kind, 0)
    # All pixels, with the border around each picture, one after another: the pixel below is `down` further on.
    p, down = pictures.ravel(), w + 2
    size, ridge, firm = np.zeros_like(p), np.zeros(len(p), bool), np.zeros(len(p), bool)
    inner = slice(down + 1, len(p) - down - 1)
    column = p[: -2 * down] + p[2 * down :]
    column += p[down:-down]
    column += p[down:-down]
    gx = column[2:] - column[:-2]
    row = p[:-2] + p[2:]
    row += p[1:-1]
    row += p[1:-1]
    gy = row[2 * down :] - row[: -2 * down]
    # Neither gradient is 0 where it is neither flat nor steep.
    falling = (gx > 0) == (gy > 0)
    wide, high = np.abs(gx, out=gx), np.abs(gy, out=gy)
    np.add(wide, high, out=size[inner])
    around = size.reshape(pictures.shape)
    around[:, [0, -1]], around[:, :, [0, -1]] = 0, 0
    at = size[inner]

    def peak(step: int) -> np.ndarray:
        """More than a step before, and no less than a step on."""
        more = size[step:] > size[:-step]
        return more[down + 1 - step : len(p) - down - 1 - step] > more[down + 1 : len(p) - down - 1]

    wide, high = wide.astype(real), high.astype(real)
    flat, steep = high <= wide * real(np.tan(np.pi / 8)), high >= wide * real(np.tan(3 * np.pi / 8))
    slanted = (falling & peak(down + 1)) | (~falling & peak(down - 1))
    ridge[inner] = ((flat & peak(1)) | (~flat & ((steep & peak(down)) | (~steep & slanted)))) & (at > weak)
    firm[inner] = ridge[inner] & (at > strong)
    return linked_ridges(*(x.reshape(pictures.shape)[:, 1:-1, 1:-1] for x in (ridge, firm))).reshape(grey.shape)


def votes_of(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rounded distance from the origin of the line through each pixel at each angle."""
    if not len(x):
        return np.zeros((0, len(ANGLES)), np.int64)
    across, down = (np.arange(v.max() + 1)[:, None] * f for v, f in ((x, COS), (y, SIN)))
    out = across[x]
    out += down[y]
    return np.rint(out, out=out).astype(np.int64)


def dealt(votes: np.ndarray) -> tuple[np.ndarray, int]:
    """Where votes are counted, and how many distances an angle has."""
    low, width = votes.min(), int(votes.max() - votes.min()) + 1
    return votes - low + np.arange(len(ANGLES)) * width, width


@lru_cache(maxsize=4)
def places(height: int, width: int) -> tuple[np.ndarray, int]:
    """dealt votes of all pixels."""
    return dealt(votes_of(*np.divmod(np.arange(height * width), width)))


def runs(along: np.ndarray, gap: int) -> list[np.ndarray]:
    """Places, in order along a line, cut where more than `gap` pixels are missing."""
    order = np.argsort(along, kind="stable")
    cuts = np.nonzero(np.diff(along[order]) > gap + 1)[0] + 1
    return np.split(order, cuts)


def segments(edge: np.ndarray, least: float, votes: int = VOTES, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """x1, y1, x2, y2 of segments at least `least` long. The line with most votes comes first (ties: least angle, then distance).

    Its pixels with gaps of at most `gap` make segments; those leave the picture with all their votes. A line that gives no
    segment is passed over. Ends when no line has `votes` votes.
    """
    y, x = np.nonzero(edge)
    if len(x) < votes:
        return []
    if edge.size <= TABLED:
        table, width = places(*edge.shape)
        place = table.take(y * edge.shape[1] + x, 0)
    else:
        place, width = dealt(votes_of(y, x))
    size = len(ANGLES) * width
    count = np.bincount(place.ravel(), minlength=size)
    left, found = np.ones(len(x), bool), []
    while True:
        best = int(count.argmax())
        if count[best] < votes:
            return found
        a = best // width
        on = np.nonzero(left & (place[:, a] == best))[0]
        along = y[on] * np.cos(ANGLES[a]) - x[on] * np.sin(ANGLES[a])
        taken = []
        for run in runs(along, gap):
            first, last = on[run[0]], on[run[-1]]
            if np.hypot(float(x[last] - x[first]), float(y[last] - y[first])) >= least:
                found.append((int(x[first]), int(y[first]), int(x[last]), int(y[last])))
                taken.append(on[run])
        if not taken:
            count[best] = -1
            continue
        gone = np.concatenate(taken)
        left[gone] = False
        count -= np.bincount(place[gone].ravel(), minlength=size)


def frame_angles(height: int, width: int) -> list[np.ndarray]:
    """Angles at which a line can have a level, and an upright, segment of a frame: both ends are within half a pixel of the line."""
    least, c, s = int(min(height, width) * 0.35), np.abs(COS), np.abs(SIN)
    long = lambda side: max(int(side * 0.30) + 1, np.sqrt(max(least**2 - (SLANT - 1) ** 2, 0)))
    return [np.flatnonzero(long(side) * off <= (SLANT - 1) * to + 1 + 1e-6) for side, off, to in ((width, c, s), (height, s, c))]


@lru_cache(maxsize=16)
def strips(height: int, width: int) -> list[tuple[bool, int, int, int, list[tuple[int, int, int, int]]]]:
    """For each angle of frame_angles: whether it is a level one, the angle, its least distance, how many distances it has, and the parts of
    columns (of rows, for an upright one) whose pixels have distances one after another: column, first pixel, end, place of the first."""
    out = []
    for level, angles in zip((True, False), frame_angles(height, width), strict=True):
        for a in angles.tolist():
            place = np.rint(np.arange(width) * COS[a] + np.arange(height)[:, None] * SIN[a]).astype(int)
            low, parts = int(place.min()), []
            for k, along in enumerate((place - place.min()).T if level else place - place.min()):
                # Distances fall along a row where the cosine is below 0; its pixels are then taken from the end.
                along = along if along[-1] >= along[0] else along[::-1]
                cuts = [0, *(np.flatnonzero(np.diff(along) != 1) + 1).tolist(), len(along)]
                parts += [(k, i, j, int(along[i])) for i, j in zip(cuts, cuts[1:], strict=False)]
            out.append((level, a, low, int(place.max()) - low + 1, parts))
    return out


@lru_cache(maxsize=4)
def adding(height: int, width: int, size: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]]:
    """Room for the edges of `size` pictures, laid by columns, by rows and by rows from their ends, and for each of strips the room for
    its votes, with views of what is added where."""
    lane = np.uint8 if 2 * (height + width) < 256 else np.uint16
    room = [np.zeros((*shape, size), lane) for shape in ((width, height), (height, width), (height, width))]
    most = max((count for *_, count, _ in strips(height, width)), default=0)
    votes, out = np.zeros((most, size), lane), []
    sums, words = votes.view(np.uint64), [r.view(np.uint64) for r in room]
    for level, a, low, count, parts in strips(height, width):
        own = words[0 if level else 1 if COS[a] >= 0 else 2]
        out.append((a, low, votes[:count], [(sums[at : at + j - i], own[k, i:j]) for k, i, j, at in parts]))
    return room, out


def rivals(edge: np.ndarray, votes: int = VOTES) -> list[list[tuple[int, int]]]:
    """For each of many pictures' edges: the lines (angle, distance) that have enough votes for a frame's segments at first.

    Eight pictures' votes are added at a time, as the bytes (or four, as pairs of bytes) of one number.
    """
    n, h, w = edge.shape
    (columns, rows, turned), angles = adding(h, w, -(-n // LANES) * LANES)
    rows[..., :n] = edge.transpose(1, 2, 0)
    rows[..., n:] = 0
    columns[:], turned[:] = rows.transpose(1, 0, 2), rows[:, ::-1]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, low, found, parts in angles:
        found[:] = 0
        for sums, own in parts:
            np.add(sums, own, sums)
        for distance, i in zip(*(x.tolist() for x in np.nonzero(found[:, :n] >= votes)), strict=True):
            out[i].append((a, distance + low))
    return out


def may_have_frame(edge: np.ndarray, lines: list[tuple[int, int]], least: float, votes: int = VOTES, gap: int = GAP) -> bool:
    """Whether two segments of a frame are possible; lines are the picture's `rivals`.

    A line still has `votes` pixels when its turn comes, so others have taken no more than it had beyond. If these can't open a gap it
    gives one segment of all it has left; two lines give two only if they have twice `votes` pixels together.
    """
    if not lines or len(lines) > FEW:
        return bool(lines)
    whole, (h, w) = [], edge.shape
    for a, distance in lines:
        on = np.flatnonzero(edge & (np.rint(np.arange(w) * COS[a] + np.arange(h)[:, None] * SIN[a]) == distance))
        y, x = np.divmod(on, w)
        along = np.sort(y * COS[a] - x * SIN[a])
        more = len(along) - votes + 1
        if (along[more:] - along[:-more] > gap + 1 - 1e-6).any():
            if len(lines) > 1:
                return True
            reach = np.sqrt(max(least**2 - 1, 0)) - 1e-6
            after = np.searchsorted(along, along + gap + 1 - 1e-6)
            split = (after < len(along)) & (after - np.arange(len(along)) <= more) & (along - along[0] >= reach)
            return bool((along[-1] - along[after[split]] >= reach).any())
        # What is left reaches from one side to the other of the nearest `votes` pixels at least.
        slant = min(abs(COS[a]), abs(SIN[a])) * (along[votes - 1 :] - along[: len(along) - votes + 1]).min() - 1
        if slant < SLANT:
            whole.append(set(on.tolist()))
    return any(len(p | q) >= 2 * votes for i, p in enumerate(whole) for q in whole[:i])


def frame_score(edge: np.ndarray) -> float:
    """Score of the edges around a face as a device's frame: segments that are long, level and upright. One alone is no frame."""
    level = upright = 0
    for xa, ya, xb, yb in segments(edge, int(min(edge.shape) * 0.35)):
        wide, high = abs(xb - xa), abs(yb - ya)
        if high < SLANT and wide > int(edge.shape[1] * 0.30):
            level += 1
        elif wide < SLANT and high > int(edge.shape[0] * 0.30):
            upright += 1
    if level and upright:
        return min(1.0, 0.40 + 0.15 * (level + upright))
    return min(0.65, 0.30 + 0.10 * max(level, upright)) if max(level, upright) >= 2 else 0.0


def bezels(grey: np.ndarray, boxes: list[Box | None]) -> np.ndarray:
    """Scores of the frame of a device around face boxes (x, y, width, height), a box for each of many pictures: long level and upright edges near it.

    Without a box, with one under 20 pixels or surroundings under 30 there is none. The surroundings reach 0.45 of the box's
    size beyond it; edges in the inner 70 % of the face don't count. Lines are taken one by one only where there may be two segments
    of a frame at all.
    """
    rows, columns = grey.shape[1:]
    out, near = np.zeros(len(grey)), defaultdict(list)
    for i, box in enumerate(boxes):
        if box is not None and min(box[2:]) >= 20:
            x, y, w, h = box
            x0, y0 = max(0, x - int(w * 0.45)), max(0, y - int(h * 0.45))
            x1, y1 = min(columns, x + w + int(w * 0.45)), min(rows, y + h + int(h * 0.45))
            if min(x1 - x0, y1 - y0) >= 30:
                near[x0, y0, x1, y1].append(i)
    for (x0, y0, x1, y1), where in near.items():
        found = np.concatenate([edges(grey[where[k : k + AT_ONCE], y0:y1, x0:x1]) for k in range(0, len(where), AT_ONCE)])
        for edge, i in zip(found, where, strict=True):
            x, y, w, h = boxes[i]
            edge[max(0, y - y0 + int(h * 0.15)) : max(0, y - y0 + int(h * 0.85)), max(0, x - x0 + int(w * 0.15)) : max(0, x - x0 + int(w * 0.85))] = False
        least = int(min(y1 - y0, x1 - x0) * 0.35)
        for edge, i, some in zip(found, where, rivals(found), strict=True):
            if may_have_frame(edge, some, least):
                out[i] = frame_score(edge)
    return out


def bezel(grey: np.ndarray, box: Box | None) -> float:
    """bezels of one picture."""
    return float(bezels(grey[None], [box])[0])
