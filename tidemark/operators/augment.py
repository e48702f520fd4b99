"""Degraded and blended pictures for training: what is done to a window is drawn by a hash of its key, then done in one Arrow pass.

The draws are columns, so they can be read and grouped like any other; they never see a label, so both classes are treated
alike, and every run repeats them. Filters work on whole windows (frames x height x width x 3 bytes).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.jpeg import COSINES, components, tables

#: Windows whose pictures are held at a time.
STEP = 32
DRAWS = "rescale double, quality int, gauss int, motion int, contrast double, brightness double, noise double, freeze int, long_freeze boolean, seed long"


def draws(key: Column, frames: Column, seed: int = 0) -> Column:
    """DRAWS as a struct, null where a filter isn't used: 85 % of windows are degraded at all, each filter at its own rate."""

    def unit(name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), key, F.lit(name)), F.lit(1 << 30)) / float(1 << 30)

    used = unit("used") < 0.85
    when = lambda name, share, value: F.when(used & (unit(name) < share), value)
    between = lambda name, low, high: low + (high - low) * unit(name)
    whole = lambda name, low, high: (low + F.floor(unit(name) * (high - low + 1))).cast("int")
    gaussian = unit("blur kind") < 0.5
    tone = lambda value: when("tone", 0.6, value)
    freeze = F.when(frames > 4, when("freeze", 0.35, (1 + F.floor(unit("frozen frame") * (frames - 2))).cast("int")))
    return F.struct(
        when("rescale", 0.6, between("scale", 0.4, 0.8)).alias("rescale"), when("compress", 0.7, whole("quality", 20, 90)).alias("quality"), when("blur", 0.5, F.when(gaussian, (3 + 2 * F.floor(unit("gauss") * 3)).cast("int"))).alias("gauss"),
        when("blur", 0.5, F.when(~gaussian, whole("motion", 3, 9))).alias("motion"), tone(between("contrast", 0.7, 1.3)).alias("contrast"), tone(between("brightness", -30.0, 30.0)).alias("brightness"), tone(between("noise", 0.0, 12.0)).alias("noise"),
        freeze.alias("freeze"), (unit("long freeze") < 0.5).alias("long_freeze"), F.xxhash64(F.lit(seed), key, F.lit("noise seed")).alias("seed"),
    )


def bytes_of(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def resampled(x: np.ndarray, axis: int, size: int, cubic: bool = False) -> np.ndarray:
    """One axis at another length, pixel centres in place: straight, or by cubics (-0.75) over four pixels; the border goes on."""
    n = x.shape[axis]
    at = (np.arange(size) + 0.5) * n / size - 0.5
    low = np.floor(at).astype(int)
    t = at - low
    if cubic:
        near = lambda d: 1.25 * d**3 - 2.25 * d**2 + 1
        far = lambda d: -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3
        taps = [(-1, far(1 + t)), (0, near(t)), (1, near(1 - t)), (2, far(2 - t))]
    else:
        taps = [(0, 1 - t), (1, t)]
    shape = [-1 if i == axis else 1 for i in range(x.ndim)]
    return sum(x.take(np.clip(low + k, 0, n - 1), axis) * w.reshape(shape) for k, w in taps)


def rescaled(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = x.shape[1:3]
    small = bytes_of(resampled(resampled(x.astype(float), 1, max(16, int(h * scale))), 2, max(16, int(w * scale)))).astype(float)
    return bytes_of(resampled(resampled(small, 1, h, True), 2, w, True))


def compressed(x: np.ndarray, quality: int) -> np.ndarray:
    """What a JPEG file of each frame leaves: coefficients of 8 x 8 blocks rounded to multiples of their divisors."""
    _, h, w, _ = x.shape
    planes = np.pad(np.stack([components(f) for f in x]), ((0, 0), (0, 0), (0, -h % 8), (0, -w % 8)), mode="edge")
    t, k, high, wide = planes.shape
    blocks = planes.reshape(t, k, high // 8, 8, wide // 8, 8).swapaxes(3, 4)
    divisors = np.stack([tables(quality)[min(i, 1)].reshape(8, 8) for i in range(3)])[None, :, None, None]
    kept = COSINES.T @ (np.rint(COSINES @ blocks @ COSINES.T / divisors) * divisors) @ COSINES
    y, b, r = np.clip(np.rint(kept.swapaxes(3, 4).reshape(t, k, high, wide)[:, :, :h, :w] + 128), 0, 255).swapaxes(0, 1)
    return bytes_of(np.stack([y + 1.402 * (r - 128), y - 0.344136 * (b - 128) - 0.714136 * (r - 128), y + 1.772 * (b - 128)], -1))


def gaussian(size: int, sigma: float | None = None) -> np.ndarray:
    """A line of weights; without a width, the one that goes with the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma**2))
    return k / k.sum()


def along(x: np.ndarray, axis: int, weights: np.ndarray) -> np.ndarray:
    """A weighted sum of neighbours along an axis; the border is mirrored without its own pixel."""
    n, before = x.shape[axis], (len(weights) - 1) // 2
    at = np.arange(-before, n + len(weights) - 1 - before)
    at = np.abs(at) if n > 1 else at * 0
    at = np.where(at >= n, np.maximum(2 * (n - 1) - at, 0), at)
    wide = x.take(at, axis)
    return sum(wide.take(range(i, i + n), axis) * w for i, w in enumerate(weights))


def toned(x: np.ndarray, contrast: float, brightness: float, noise: float, seed: int) -> np.ndarray:
    grain = np.random.default_rng(seed & (2**64 - 1)).standard_normal(x.shape) * noise
    return np.clip(x * contrast + brightness + grain, 0, 255).astype(np.uint8)


def degraded(x: np.ndarray, d: dict) -> np.ndarray:
    """The filters of DRAWS in their order."""
    on = lambda k: d[k] is not None and not pd.isna(d[k])
    if on("rescale"):
        x = rescaled(x, d["rescale"])
    if on("quality"):
        x = compressed(x, int(d["quality"]))
    if on("gauss"):
        k = gaussian(int(d["gauss"]))
        x = bytes_of(along(along(x.astype(float), 1, k), 2, k))
    if on("motion"):
        x = bytes_of(along(x.astype(float), 2, np.full(int(d["motion"]), 1 / int(d["motion"]))))
    if on("contrast"):
        x = toned(x, d["contrast"], d["brightness"], d["noise"], int(d["seed"]))
    if on("freeze"):
        x, at = x.copy(), int(d["freeze"])
        x[at] = x[at - 1]
        if d["long_freeze"]:
            x[at + 1] = x[at]
    return x


@functools.cache
def feathered(height: int, width: int, size: int = 15, sigma: float = 5.0) -> np.ndarray:
    """An ellipse in the picture's middle, 0.35 of its width and 0.45 of its height to each side, with a soft border."""
    y, x = np.mgrid[:height, :width]
    a, b = max(int(width * 0.35), 1), max(int(height * 0.45), 1)
    inside = (((x - width // 2) / a) ** 2 + ((y - height // 2) / b) ** 2 <= 1).astype(float)
    k = gaussian(size, sigma)
    return along(along(inside, 0, k), 1, k)


def blended(x: np.ndarray, contrast: float, brightness: float) -> np.ndarray:
    """Each frame over itself: a copy of other tone within the feathered ellipse, the frame itself outside."""
    mask = feathered(*x.shape[1:3])[None, :, :, None]
    source = np.clip(x * contrast + brightness, 0, 255).astype(np.uint8)
    return np.where(mask > 0, source * mask + x * (1 - mask), x).astype(np.uint8)


def augmented(windows: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """keys, draws, `degraded` and `blended` bytes of windows(keys, rgb, frames, height, width); malformed windows have null bytes.

    blended is a made-up fake: the window's own face in another tone (contrast 0.8 to 1.2, brightness within 20).
    """
    key = F.concat_ws("/", *keys)
    unit = lambda name: F.pmod(F.xxhash64(F.lit(seed), key, F.lit(name)), F.lit(1 << 30)) / float(1 << 30)
    rows = windows.withColumn("draws", draws(key, F.col("frames"), seed)).withColumn("mix", F.array(0.8 + 0.4 * unit("blend contrast"), -20.0 + 40.0 * unit("blend brightness")))
    fields = [c.split()[0] for c in DRAWS.split(", ")]
    schema = ", ".join([f"{k} {windows.schema[k].dataType.simpleString()}" for k in keys] + [DRAWS, "degraded binary, blended binary"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), STEP):
                part, made = b.iloc[at : at + STEP], []
                for r in part.to_dict("records"):
                    n, h, w = int(r["frames"]), int(r["height"]), int(r["width"])
                    if r["rgb"] is not None and n and len(r["rgb"]) == n * h * w * 3:
                        x = np.frombuffer(r["rgb"], np.uint8).reshape(n, h, w, 3)
                        made.append((degraded(x, r).tobytes(), blended(x, *r["mix"]).tobytes()))
                    else:
                        made.append((None, None))
                yield part[[*keys, *fields]].assign(degraded=[m[0] for m in made], blended=[m[1] for m in made])

    return rows.select(*keys, "rgb", "frames", "height", "width", "draws.*", "mix").mapInPandas(run, schema)
