"""Word and shingle hashes of whole texts, computed on the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2 ** 64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(1, n), np.uint64)
    np.cumprod(np.full(max(1, n) - 1, base, np.uint64), out=out[1:])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A to Z in lower case) of all texts, and the index of each text's first word (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    word = ~SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = starts[:-1][starts[:-1] < n]
    begins[edges] = word[edges]  # a text's first byte doesn't go on with the last word of the one before
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    lasts = starts[1:][starts[1:] > 0] - 1
    ends[lasts] = word[lasts]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    terms = (LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    hashes = (sums[last] - sums[first]) * powers(INVERSE, n)[first]
    return mix(hashes + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(first, starts)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words; with fewer words of the whole sequence; nothing without words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = mix(out * BASE + words[k : k + n])
    return out
