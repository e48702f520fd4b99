"""Correlations of series at lags, for a batch of rows at a time in Arrow batches."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of a series that are held as a matrix at a time.
STEP = 1 << 18
#: A part that deviates no more than this is constant.
CONSTANT = 1e-5


def _mean(rows: np.ndarray) -> np.ndarray:
    """Means of columns; summed in the series' order, as an expression over arrays does."""
    total = np.zeros(rows.shape[1])
    for x in rows:
        total = total + x
    return total / len(rows)


def correlations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pearson correlations of the columns of x and y, and where neither is constant."""
    with np.errstate(all="ignore"):
        dx, dy = x - _mean(x), y - _mean(y)
        sx, sy = np.sqrt(_mean(dx * dx)), np.sqrt(_mean(dy * dy))
        return _mean(dx * dy) / (sx * sy), ~(sx <= CONSTANT) & ~(sy <= CONSTANT)


def _columns(series: pa.ListArray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Series of one length as columns, and where their elements are null."""
    at = series.offsets.to_numpy()[rows] + np.arange(length)[:, None]
    taken = series.values.take(pa.array(at.ravel()))
    known = taken.is_valid().to_numpy(zero_copy_only=False).reshape(at.shape)
    return taken.to_numpy(zero_copy_only=False).reshape(at.shape), ~known


@cache
def _at_lags(lags: range, least: int):
    @F.arrow_udf("array<double>")
    def found(a: pa.Array, b: pa.Array) -> pa.Array:
        corr, have = np.zeros((len(a), len(lags))), np.zeros((len(a), len(lags)), bool)
        sizes = np.stack([np.asarray(s.value_lengths().fill_null(-1)) for s in (a, b)])
        for m, n in np.unique(sizes, axis=1).T.tolist():
            if min(m, n) < 0:
                continue
            same = np.flatnonzero((sizes[0] == m) & (sizes[1] == n))
            step = max(1, STEP // max(m, n, 1))
            for rows in (same[i : i + step] for i in range(0, len(same), step)):
                (x, no_x), (y, no_y) = _columns(a, rows, m), _columns(b, rows, n)
                for place, k in enumerate(lags):
                    size, i, j = m - abs(k), max(k, 0), max(-k, 0)
                    # A part without a counterpart, or with a null, has no correlation.
                    if size >= max(least, 1) and n - j >= size:
                        r, good = correlations(x[i : i + size], y[j : j + size])
                        corr[rows, place], have[rows, place] = r, good & ~(no_x[i : i + size] | no_y[j : j + size]).any(axis=0)
        flat = pa.array(corr.ravel(), mask=~have.ravel(), from_pandas=False)
        return pa.ListArray.from_arrays(np.arange(0, corr.size + 1, len(lags), dtype=np.int32), flat)

    return found


def lagged_correlations(a: Column, b: Column, lags: range, least: int) -> Column:
    """(lag, correlation) of arrays a and b for each lag: at lag k > 0 a starts k later, at k < 0 b does; null where constant or too short.

    Not for use within a lambda, as it leaves the JVM.
    """
    found = _at_lags(lags, least)(a.cast("array<double>"), b.cast("array<double>"))
    return F.transform(found, lambda r, i: F.struct((i * lags.step + lags.start).alias("lag"), r.alias("corr")))
