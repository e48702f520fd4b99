"""A row for each frame of a window: sharpness, brightness, the mean colours of three regions, and the face as a square crop.

Means of boxes come from summed-area tables that all frames of a window share, so a region costs four reads a channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pixels import box_of, grey, laplacian

CROP = 160
COLOUR = "struct<cr:double,cg:double,mean_r:double,mean_g:double,mean_b:double>"
FRAME = f"frame int, blur double, brightness double, face {COLOUR}, neck {COLOUR}, background {COLOUR}, crop binary"
#: Colour of an empty region.
NO_COLOUR = {"cr": 0.333, "cg": 0.333, "mean_r": 128.0, "mean_g": 128.0, "mean_b": 128.0}

Region = tuple[int, int, int, int]


def summed_areas(rgb: np.ndarray) -> np.ndarray:
    """For each frame and channel, sums of all pixels above and left of each corner."""
    return np.pad(rgb.astype(np.int64).cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0), (0, 0)))


def box_means(areas: np.ndarray, region: Region) -> np.ndarray | None:
    """Mean colour of rows y0..y1 and columns x0..x1 of each frame; None for an empty region."""
    y0, y1, x0, x1 = region
    if y1 <= y0 or x1 <= x0:
        return None
    return (areas[:, y1, x1] - areas[:, y0, x1] - areas[:, y1, x0] + areas[:, y0, x0]) / ((y1 - y0) * (x1 - x0))


def regions(box: Region | None, height: int, width: int) -> dict[str, Region]:
    """Rows and columns of face, neck and background: the middle of the face box, a strip below it, the picture's corner."""
    cut = lambda y0, y1, x0, x1: (min(max(y0, 0), height), min(max(y1, 0), height), min(max(x0, 0), width), min(max(x1, 0), width))
    corner = cut(0, max(10, int(height * 0.2)), 0, max(10, int(width * 0.2)))
    if box is None:
        return {"face": (0, height, 0, width), "neck": (0, height, 0, width), "background": corner}
    x, y, w, h = box
    top = min(height - 1, y + h + int(h * 0.05))
    return {
        "face": cut(y + int(h * 0.3), y + int(h * 0.7), x + int(w * 0.3), x + int(w * 0.7)),
        "neck": cut(top, top + min(height - top, int(h * 0.25)), x + int(w * 0.25), x + int(w * 0.75)),
        "background": corner,
    }


def resized(picture: np.ndarray, size: int) -> np.ndarray:
    """The picture as size x size pixels, straight between the centres of its own."""
    out = picture.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if i == axis else 1 for i in range(3)])
        out = out.take(low, axis) * (1 - part) + out.take(np.minimum(low + 1, n - 1), axis) * part
    return np.rint(out).astype(np.uint8)


def frames_of(rgb: np.ndarray, box: Region | None, crop: int = CROP) -> list[tuple]:
    """FRAME's values of each frame."""
    height, width = rgb.shape[1:3]
    areas, colours = summed_areas(rgb), {}
    for name, region in regions(box, height, width).items():
        means = box_means(areas, region)
        if means is None:
            colours[name] = [NO_COLOUR] * len(rgb)
        else:
            total = means.sum(1) + 1e-6
            colours[name] = [{"cr": m[0] / t, "cg": m[1] / t, "mean_r": m[0], "mean_g": m[1], "mean_b": m[2]} for m, t in zip(means.tolist(), total.tolist(), strict=True)]
    out = []
    for i, frame in enumerate(rgb):
        x, y, w, h = box or (0, 0, width, height)
        face = frame[max(0, y) : max(0, min(height, y + h)), max(0, x) : max(0, min(width, x + w))]
        g = grey(frame)
        out.append((i, float(laplacian(g).var()), float(g.mean()), *(colours[k][i] for k in ("face", "neck", "background")), resized(face if face.size else frame, crop).tobytes()))
    return out


def preprocessed(windows: DataFrame, keys: list[str], crop: int = CROP) -> DataFrame:
    """keys and FRAME for each frame of windows(keys, rgb binary, frames, height, width, box); a window whose bytes don't fit its size has no frames."""
    schema = ", ".join([f"{k} {windows.schema[k].dataType.simpleString()}" for k in keys] + [FRAME])
    names = [*keys, *[c.split()[0] for c in FRAME.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            boxes = b["box"].to_dict("records") if isinstance(b["box"], pd.DataFrame) else b["box"]
            # A window at a time: its crops may be larger than itself.
            for key, block, n, h, w, box in zip(b[keys].itertuples(index=False, name=None), b["rgb"], b["frames"], b["height"], b["width"], boxes, strict=True):
                if block is not None and n and len(block) == n * h * w * 3:
                    rgb = np.frombuffer(block, np.uint8).reshape(int(n), int(h), int(w), 3)
                    yield pd.DataFrame([(*key, *f) for f in frames_of(rgb, box_of(box), crop)], columns=names)

    return windows.select(*keys, "rgb", "frames", "height", "width", F.col("box")).mapInPandas(run, schema)
