"""64-bit hashes of words and of runs of words, over whole batches at once."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch one after another, and where each document begins (one entry more than documents)."""
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=ends[1:])
    digest = xxhash.xxh3_64_intdigest
    out = np.empty(int(ends[-1]), np.uint64)
    for w, a, b in zip(words, ends[:-1], ends[1:]):
        if b > a:
            out[a:b] = np.fromiter(map(digest, w), np.uint64, len(w))
    return out, ends


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose low and high bits all depend on the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` words, by position of its first (``len(x) - n + 1`` of them), from running sums of a polynomial."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    step = (_STEP + 2 * seed) & _MASK
    inverse = pow(step, -1, 1 << 64)
    down = np.full(len(x), inverse, np.uint64)
    down[0] = 1
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * np.cumprod(down), out=sums[1:])
    up = np.full(len(x) - n + 1, step, np.uint64)
    up[0] = 1
    return mix((sums[n:] - sums[:-n]) * np.cumprod(up))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    if len(x) < width:
        return np.empty(0, x.dtype)
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have:])
