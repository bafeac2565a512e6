"""Words, shingles and their 64-bit hashes, computed over whole batches of UTF-8 bytes.

A word is `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased. Its hash is a polynomial over its bytes modulo 2**64 at a
fixed odd point, finished by a bijective mixer; prefix sums give all words of a batch at once.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POINT = 0x9E3779B97F4A7C15
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 2 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the point and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())  # a worker keeps them
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, p, np.uint64)])) for p in (_POINT, pow(_POINT, -1, 2**64))]
    return _powers


#: Bytes between words of letters: all of ASCII but its letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[128:] = NOT_LETTER[65:91] = NOT_LETTER[97:123] = False


def bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a row's end also ends a word. between: whether a byte is outside words."""
    word = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    return np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _tables(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * power[: len(data)])])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE, most: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (of their first `most` bytes) in order, and where each row's begin among them (one entry
    more than rows)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = bounds(data, offsets, between)
    first = np.searchsorted(starts, offsets)
    ends = np.minimum(ends, starts + most)
    if len(data) <= _PIECE:
        return _hashed(data, starts, ends), first
    parts, at = [], 0
    while at < len(starts):  # a long row goes piece by piece, cut between words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE, "right")))
        low, high = starts[at], ends[to - 1]
        parts.append(_hashed(data[low:high], starts[at:to] - low, ends[at:to] - low))
        at = to
    return np.concatenate(parts), first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, not yet distinct; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, np.uint64(width * 0xD6E8FEB86659FD93 % 2**64))
    for j in range(width):
        total += words[j : len(words) - width + 1 + j] * _PLACE[j]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row its distinct shingle hashes, sorted."""
    words, first = word_hashes(data, offsets)
    return [np.unique(shingle_hashes(words[a:b], size)) for a, b in zip(first[:-1], first[1:])]
