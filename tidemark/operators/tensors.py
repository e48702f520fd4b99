"""Feature tensors and evidence pictures of windows, by numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.operators.pixels import grey, laplacian, sobel

SECOND, FRAME, WIDTH = 16000, 320, 768
SIDE = 16
EVIDENCE_LOGIT = 0.40


def acoustic(pcm: np.ndarray) -> np.ndarray:
    """The newest second as 50 frames of 768: log spectra of Hann windows, each scaled to mean 0 and deviation 1, repeated to the width."""
    signal = np.zeros(SECOND, np.float32)
    newest = np.asarray(pcm[-SECOND:], np.float32)
    if len(newest):
        signal[-len(newest) :] = newest
    frames = (signal / (np.abs(signal).max() + 1e-6)).reshape(-1, FRAME)
    size = np.log(np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) + 1e-6)
    scaled = (size - size.mean(1, keepdims=True)) / (size.std(1, keepdims=True) + 1e-6)
    return scaled[:, np.arange(WIDTH) % scaled.shape[1]].astype(np.float32)


def shrunk(a: np.ndarray, side: int = SIDE) -> np.ndarray:
    """a on side x side points, straight lines between pixel centres."""
    for axis in (0, 1):
        n = a.shape[axis]
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(0, n - 2))
        part = np.expand_dims(at - low, 1 - axis)
        a = np.take(a, low, axis) * (1 - part) + np.take(a, np.minimum(low + 1, n - 1), axis) * part
    return a


def visual(crops: np.ndarray, frames: int = 8) -> np.ndarray:
    """`frames` evenly chosen crops as 512 values of length 1: brightness and gradients on 16 x 16 points."""
    places = [k * (len(crops) - 1) // (frames - 1) for k in range(frames)]
    out = []
    for place in places:
        g = grey(crops[place]) / 255.0
        both = np.concatenate([shrunk(g).ravel(), shrunk(np.hypot(*sobel(g))).ravel()])
        out.append(both / (np.linalg.norm(both) + 1e-6))
    return np.array(out, np.float32)


def heat_map(crop: np.ndarray) -> np.ndarray:
    """35 parts of a colour scale (blue to red) of the absolute Laplacian over 65 parts of the crop."""
    size = np.abs(laplacian(grey(crop)))
    v = (size - size.min()) / max(1e-9, float(size.max() - size.min()))
    colours = np.stack([np.clip(1.5 - np.abs(4 * v - k), 0, 1) for k in (3, 2, 1)], -1) * 255
    return np.clip(np.rint(0.65 * crop[..., :3] + 0.35 * colours), 0, 255).astype(np.uint8)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def acoustic_tensor(pcm: pd.Series) -> pd.Series:
    """50 x 768 values, row after row; null samples count as none."""
    return pcm.map(lambda x: acoustic(np.zeros(0) if x is None else np.asarray(x)).ravel())


def _crops(data: bytes | None, side: int) -> np.ndarray:
    return np.frombuffer(data or b"", np.uint8).reshape(-1, side, side, 3)


def visual_tensor(crops: Column, side: int) -> Column:
    """8 x 512 values of a window's square RGB crops (one block of bytes); null with fewer than 8."""

    @F.pandas_udf("array<float>")
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: visual(c).ravel() if len(c := _crops(b, side)) >= 8 else None)

    return run(crops)


def evidence(crops: Column, side: int, edge: Column) -> Column:
    """The heat map of a window's middle crop as RGB bytes, where the edge logit is 0.40 or more."""

    @F.pandas_udf("binary")
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: heat_map(c[len(c) // 2]).tobytes() if len(c := _crops(b, side)) else None)

    return F.when(edge >= EVIDENCE_LOGIT, run(F.when(edge >= EVIDENCE_LOGIT, crops)))


def guarded_spoof(logit: Column, pcm: Column) -> Column:
    """Spoof maximum and mean from a voice logit; silence (deviation under 50) and logits up to 0 are none."""
    loud = (C.deviation(F.transform(pcm, lambda x: x.cast("double"))) >= 50.0) & (logit > 0)
    most = F.when(F.coalesce(loud, F.lit(False)), C.clip(logit / 3.0, 0, 1)).otherwise(0.0)
    return F.struct(most.alias("spoof_max"), (0.75 * most).alias("spoof_mean"))


def first_trust(blur: Column, brightness: Column, face_ratio: Column) -> Column:
    """Trust as preprocessing gives it, before the quality module's."""
    light = 1 - F.least(F.lit(1.0), F.abs(brightness - 128.0) / 100.0)
    return C.clip(0.5 * C.ramp(blur, 20, 100) + 0.3 * light + 0.2 * face_ratio, 0, 1)
