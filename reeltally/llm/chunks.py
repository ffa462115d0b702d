"""Distinct chunks of symbol sequences, found without an object for each chunk."""

from __future__ import annotations

import numpy as np
import pandas as pd

from reeltally.llm.shingles import mixed


def distinct(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``first``: the number of one chunk for each different chunk; ``which``: the place in ``first`` for every chunk.

    Chunk i is ``symbols[begins[i]:begins[i + 1]]``, the last one goes to the end; none is empty.  Chunks meet by a 64-bit hash and
    are then compared symbol by symbol: where hashes collide a chunk stands for itself, so ``first`` may hold it twice.
    """
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(begins, append=len(symbols))
    place = np.arange(len(symbols)) - np.repeat(begins, size)
    key = mixed((symbols.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))
    which = pd.factorize(np.add.reduceat(key, begins))[0].astype(np.int64)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1) > 0)
    head = first[which]
    apart = size != size[head]
    np.add(place, np.repeat(np.where(apart, begins, begins[head]), size), out=place)
    apart |= np.logical_or.reduceat(symbols[place] != symbols, begins)
    odd = np.flatnonzero(apart)
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), which


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``flat[begins[w] : begins[w] + sizes[w]]`` for every w of ``which``, one behind the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[which] - (ends - n), n)
    return flat[at]
