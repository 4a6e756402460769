"""Vectorised words of UTF-8 text: boundaries, 64-bit word hashes and hashes of word shingles.

Works on the Arrow buffers of whole batches; nothing here loops over words in Python.
Equality of 64-bit hashes stands for equality of words (chance of a clash within a pair of
texts of 10,000 words: about 1e-11).
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: all but white space; digits, letters and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, _P_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of a 64-bit value over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_bounds(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (byte positions), and for each row the index of its first word (n + 1 values)."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = word_bytes[raw]
    step = np.diff(inside)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a word never spans two rows
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cuts):
        cuts = np.unique(cuts)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, A-Z as a-z."""
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[raw]] * up[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence where it is shorter; empty without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out += words[i : n - k + 1 + i] * _SHINGLE[i % 64]
    return mix(out)


def sets_of_shingles(raw: np.ndarray, offsets: np.ndarray, k: int = 5):
    """For each row, its sorted distinct shingle hashes."""
    starts, ends, first = word_bounds(raw, offsets, NOT_SPACE)
    hashes = word_hashes(raw, starts, ends)
    for i in range(len(offsets) - 1):
        yield np.unique(shingle_hashes(hashes[first[i] : first[i + 1]], k))
