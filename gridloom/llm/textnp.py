"""Vectorised words and word shingles over UTF-8 buffers.

Words are runs of anything but the six ASCII space characters, so they can be
found on bytes.  A word's 64-bit hash is a polynomial over a fixed random table,
finished by a mixer; a shingle's hash combines its words' hashes and their number.
Hashes agree across processes.  Two different shingles among ``n`` get the same
hash with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(20_240_611)).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """At least the first ``n`` powers of the odd step, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 64), _STEP, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; rows never share a word."""
    if not len(buf):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    inside = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(buf), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty slice."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    values = _TABLE[buf[np.repeat(starts, lengths) + place]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, before) + lengths.astype(np.uint64) * _STEP)


def windows(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of each run of ``size`` words of one row."""
    n = len(words) - size + 1
    if n <= 0:
        empty = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), empty, empty
    value = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        value += words[j : j + n] * powers(size + 1)[j + 1]
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return mix(value[at]), at, rows[at]


def sequence(words: np.ndarray) -> np.ndarray:
    """The hash of one run of words, as ``windows`` gives it, in an array of one."""
    value = np.full(1, len(words), dtype=np.uint64)
    if len(words):
        value += (words * powers(len(words) + 1)[1 : len(words) + 1]).sum(dtype=np.uint64)
    return mix(value)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; A-Z count as a-z.

    A row with fewer than ``size`` words has its whole sequence as the one
    shingle; a row without words has none.
    """
    low = LOWER[buf]
    starts, ends, rows = spans(low, offsets)
    words = hashes(low, starts, ends)
    found, _, of = windows(words, rows, size)
    n = len(offsets) - 1
    by_row = np.searchsorted(of, np.arange(n + 1))
    by_word = np.searchsorted(rows, np.arange(n + 1))
    out = []
    for i in range(n):
        if by_row[i] < by_row[i + 1]:
            out.append(np.unique(found[by_row[i] : by_row[i + 1]]))
        elif by_word[i] < by_word[i + 1]:
            out.append(sequence(words[by_word[i] : by_word[i + 1]]))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
