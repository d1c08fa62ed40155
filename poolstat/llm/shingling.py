"""Word and shingle hashes of whole texts, vectorised over bytes.

A word's hash is a polynomial over a random value of each byte, taken from one running sum of the text, then mixed;
two words or shingles fall together with a chance of about 2**-60.
"""

from __future__ import annotations

import numpy as np
import xxhash

PIECE = 1 << 20
MIX, FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, x in (("up", BASE), ("down", INVERSE)):
                v = np.full(n, np.uint64(x))
                v[0] = 1
                setattr(self, name, np.multiply.accumulate(v))


POWERS = _Powers()


def word_spans(data: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not `apart`."""
    outside = np.ones(len(data) + 2, dtype=bool)
    np.take(apart, data, out=outside[1:-1])
    edge = np.flatnonzero(outside[1:] != outside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; a text of over PIECE bytes is taken in pieces that end with a word."""
    out, w = np.empty(len(starts), dtype=np.uint64), 0
    while w < len(starts):
        at = starts[w]
        last = max(w + 1, int(np.searchsorted(ends, at + PIECE, side="right")))
        n = int(ends[last - 1] - at)
        POWERS.reach(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.take(VALUES, data[at : at + n], out=sums[1:])
        sums[1:] *= POWERS.up[:n]
        np.cumsum(sums, out=sums)
        s, e = starts[w:last] - at, ends[w:last] - at
        h = (sums[e] - sums[s]) * POWERS.down[s]
        h ^= h >> np.uint64(29)
        h *= FOLD
        out[w:last] = h ^ (h >> np.uint64(32))
        w = last
    return out


def rolled(v: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes."""
    n = len(v) - width + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = (h ^ v[k : k + n]) * MIX
        h ^= h >> np.uint64(32)
    return h


def distinct(v: np.ndarray) -> np.ndarray:
    """Sorted without repeats."""
    v = np.sort(v)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z are lower-cased, words end at \\t-\\r and space only."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = word_spans(data)
    if len(starts) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(raw.split()))] if len(starts) else [], dtype=np.uint64)
    return distinct(rolled(word_hashes(data, starts, ends), width))
