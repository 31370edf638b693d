"""Vectorised hashing of words, shingles and windows (NumPy, inside tasks).

A prefix sum of ``symbol[i] * G**i`` modulo 2**64 gives the hash of any run of
symbols in constant time; a finaliser spreads the bits. Words are the maximal runs
of bytes other than space and ``\\t \\n \\v \\f \\r``; as the text is UTF-8, cutting
at these bytes equals cutting at these characters.
"""

from __future__ import annotations

import numpy as np

_G = 0x9E3779B97F4A7C15 | 1
_G_INVERSE = pow(_G, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Symbols hashed at once; longer texts go in pieces.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """G**i and G**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]))
        for k, g in enumerate((_G, _G_INVERSE)):
            steps = np.full(size, g, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix(symbols: np.ndarray) -> np.ndarray:
    up, _ = _power(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:-1], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbols [start, end), by the prefix sums of one array."""
    _, down = _power(len(sums))
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * down[start] + length * np.uint64(0xD6E8FEB86659FD93))


def windows(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k symbols."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _power(len(sums))
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def byte_symbols(text: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(text, np.uint8)]


def word_symbols(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word."""
    if len(text) <= PIECE:
        return _words(text)
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        found.append(_words(text[at:end]))
        at = end
    return np.concatenate(found)


def _words(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    return ranges(prefix(_BYTE[raw]), edge[::2], edge[1::2])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; the whole sequence where it is shorter; none of no words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(windows(prefix(words), min(k, len(words))))


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x
