"""Hashes of word shingles, for many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_Q = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _P, np.uint64)
    down = np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle its text's place in the list (ascending) and its 64-bit hash, repeats included.

    Words are what white space (U+0020 and below) parts, as they are written.  A text with fewer words is one shingle, one
    with none has none.
    """
    data = b"".join(b" " + t.encode() + b" " for t in texts)
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = raw > 32
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    up, down = _powers(1 << int(len(raw)).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * up[: len(raw)], out=sums[1:])
    word = mixed((sums[end] - sums[start]) * down[start])

    stop = np.searchsorted(start, np.cumsum([len(t.encode()) + 2 for t in texts]))
    counts = np.diff(stop, prepend=0)
    made = np.maximum(counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), made)
    first = np.arange(len(doc)) + np.repeat(stop - counts - (np.cumsum(made) - made), made)
    last = stop[doc]
    total = np.zeros(len(doc), np.uint64)
    for j in range(words):
        at = first + j
        have = at < last
        total = total * _Q + np.where(have, word[np.minimum(at, len(word) - 1)] if len(word) else 0, np.uint64(j + 1))
    return doc, mixed(total)
