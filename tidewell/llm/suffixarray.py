"""Suffix-array dedup over bytes by prefix-free parsing.

Rolling-hash triggers cut the texts into phrases that overlap by a window less one byte;
the dictionary holds each distinct phrase once, and the parse is the table of where
phrases occur (see ``repeats``). The dictionary is sorted in shards by prefix doubling: ranks
of 8, 16, ... 256 bytes, then of whole windows. Windows that share a rank share their
first ``WINDOW`` bytes: their common prefix with a neighbour in corpus order is long
enough. The ranks at ``PASSAGE`` bytes, which the doubling passes anyway, show shorter
passages that repeat; they are counted (``repeated``), never cut. Parse and ranks combine: a phrase that the parse holds twice needs no comparison,
and what one copy of a phrase shows holds for all its places, so highly
repetitive text is sorted once.

Defined results: null is the empty text; texts shorter than a window lose nothing; matches
never cross documents; repeated rows lose what is long enough; cutting is by bytes, so
a kept text may hold parts of characters; an empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import fingerprints as fp
from .repeats import Kind, remove_repeats

WINDOW, PASSAGE, TRIGGER = 400, 256, 64


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def window_ranks(text: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Ranks of all windows of ``text`` (bytes) for each length, the longest first; fewer than 2**32 places."""
    out = []
    size = 8 if lengths[-1] >= 8 else 1
    keys = np.zeros(max(0, len(text) - size + 1), np.uint64)
    for i in range(size):
        keys = (keys << np.uint64(8)) | text[i : i + len(keys)]
    ranks = _ranks(keys)
    for window in reversed(lengths):
        while 2 * size <= window:
            ranks = _ranks((ranks[:-size] << np.uint64(32)) | ranks[size:])
            size *= 2
        n = max(0, len(text) - window + 1)
        out.append(ranks[:n] if size == window else _ranks((ranks[:n] << np.uint64(32)) | ranks[window - size : window - size + n]))
    return out[::-1]


def _counted(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How much weight the key of each place has in all."""
    _, of = np.unique(keys, return_inverse=True)
    return np.bincount(of, weights)[of] if len(of) else np.zeros(0)


def repeated_windows(phrases: list[bytes], weights: list[int], starts: list[int], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each phrase (weight 2 if it occurs twice) and length, which of its first ``starts`` places start a repeated window.

    Windows whose hash stands alone are not repeated; what lies outside the other windows is not ranked.
    """
    sizes = np.array([len(p) for p in phrases], np.int64)
    counts = [np.maximum(0, np.minimum(starts, sizes - n + 1)) for n in lengths]
    first = np.cumsum(sizes) - sizes
    hashes = fp.windows(fp.prefix(fp.byte_symbols(b"".join(phrases))), lengths[-1])
    own = np.repeat(np.arange(len(phrases)), counts[-1])
    place = np.arange(len(own)) - np.repeat(np.cumsum(counts[-1]) - counts[-1], counts[-1])
    maybe = np.flatnonzero(_counted(hashes[first[own] + place], np.array(weights)[own]) >= 2)
    out = [[np.zeros(c[i], bool) for c in counts] for i in range(len(phrases))]
    if not len(maybe):
        return out
    # of each phrase with such windows, what they cover at their longest
    some, low = np.unique(own[maybe], return_index=True)
    low, high = place[maybe[low]], place[maybe[np.append(low[1:], len(maybe)) - 1]] + 1
    trimmed = [phrases[i][a : b + lengths[0] - 1] for i, a, b in zip(some, low, high, strict=True)]
    sizes = np.array([len(p) for p in trimmed], np.int64)
    first = np.cumsum(sizes) - sizes
    for k, ranks in enumerate(window_ranks(np.frombuffer(b"".join(trimmed), np.uint8), lengths)):
        n = np.maximum(0, np.minimum(high - low, sizes - lengths[k] + 1))
        own = np.repeat(np.arange(len(some)), n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        good = _counted(ranks[first[own] + place], np.array(weights)[some][own]) >= 2
        for i, a, mask in zip(some, low, np.split(good, np.cumsum(n)[:-1]), strict=True):
            out[i][k][a : a + len(mask)] = mask
    return out


BYTES = Kind((WINDOW, PASSAGE), TRIGGER, (64, 16, 4, 1), fp.byte_symbols, lambda t: t, bytes, repeated_windows)


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Bytes covered by repeated windows go; ``ranges`` and ``n`` count bytes, ``repeated`` those under windows of ``WINDOW`` and of ``PASSAGE``."""
    return remove_repeats(docs, BYTES, doc_id, text, keep_text)
