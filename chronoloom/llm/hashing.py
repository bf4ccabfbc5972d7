"""Vectorised hashes of words and of byte ranges, shared by the operators on texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from chronoloom.llm.common import BLOCK, mix64

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII bytes that are neither letters nor digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; call with a rounded n."""
    out = []
    for b in (BASE, _INVERSE):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK + 2
    while size < n + 1:
        size *= 2
    return powers(size)


class PrefixHash:
    """Prefix polynomial hashes of a byte array: ``of(lo, hi)`` hashes data[lo:hi] by its content alone."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = powers_for(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]


def word_hashes(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased) of a byte array, and
    where they start. Works in segments that end at white space. ``space`` may hold other separators."""
    hashes, starts, _ = words_at(data, space)
    return hashes, starts


def words_at(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of words."""
    hashes, starts, ends, i, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, len(data)
    while i < n:
        j = min(n, i + BLOCK)
        if j < n:
            at = np.flatnonzero(space[data[i:j]])
            if len(at):
                j = i + int(at[-1]) + 1
            else:
                more = np.flatnonzero(space[data[j:]])
                j = j + int(more[0]) + 1 if len(more) else n
        part = data[i:j]
        gap = space[part]
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        lo, hi = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        h = PrefixHash(LOWER[part])
        hashes.append(mix64(h.of(lo, hi) + (hi - lo).astype(np.uint64) * BASE))
        starts.append(lo + i)
        ends.append(hi + i)
        i = j
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * BASE + words[k : k + m]
    return mix64(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, of the whole sequence."""
    if not len(words):
        return words
    return np.unique(sequence_hashes(words, n) if len(words) >= n else sequence_hashes(words, len(words)) + np.uint64(len(words)))
