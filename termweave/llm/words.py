"""Words of UTF-8 bytes, found and hashed with array operations.

A text's words are runs of bytes of a chosen class. The 64-bit hash of a word is a
polynomial in its bytes, finished by a mixing step; it depends on nothing else, so
equal words have equal hashes in every task and every run.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
NOT_BLANK = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTER_OR_DIGIT = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class Words(NamedTuple):
    """Words of some rows: where each row's words begin, and of each word its hash and bytes."""

    bounds: np.ndarray  # of rows, into the arrays of words; one more than there are rows
    hashes: np.ndarray
    starts: np.ndarray  # byte offset from the first row's start
    lengths: np.ndarray
    first: np.ndarray  # index of a word's first byte in ``letters``
    letters: np.ndarray  # the folded bytes of all words


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of BASE modulo 2**64."""
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 2 * len(_powers)), BASE, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def find(raw: np.ndarray, ends: np.ndarray, of_word: np.ndarray) -> Words:
    """Find and hash the words of rows whose bytes lie at ``ends`` in ``raw``."""
    data = raw[ends[0] : ends[-1]]
    begin = ends[:-1] - ends[0]
    inside = of_word[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = begin[begin < len(data)]
    opens[edge] = inside[edge]
    starts = np.flatnonzero(opens)
    bounds = np.append(np.searchsorted(starts, begin), len(starts))
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return Words(bounds, none.astype(np.uint64), none, none, none, none.astype(np.uint8))
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    letters = FOLD[data[at]]
    place = np.arange(len(at)) - np.repeat(first, lengths)
    table = powers(int(lengths.max()) + 1)
    sums = np.add.reduceat((letters + np.uint64(1)) * table[place], first)
    return Words(bounds, mix(sums ^ lengths.astype(np.uint64)), starts, lengths, first, letters)
