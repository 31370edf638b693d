"""Substring dedup over words: suffix automata of reference shards give matching statistics.

The reference is the corpus itself. To stream every document past automata of the whole
corpus would cost the square of it, so the shards hold only what can match: the
distinct phrases whose trigger occurs more than once (see ``repeats``), and are met by the
phrases of the same shard, not by all documents. In a shard one generalised suffix
automaton takes every phrase; each state counts the ends of its strings, and a phrase
streamed through it is repeated where the state of its last ``WINDOW`` words has a second end.

Defined results: words are runs of other characters than space and ``\\t \\n \\v \\f \\r``;
null, empty and shorter texts lose nothing; repeated rows lose what is long enough;
an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import fingerprints as fp
from .automaton import WordAutomaton
from .repeats import Kind, remove_repeats

WINDOW, TRIGGER = 35, 6


def repeated_windows(phrases: list[bytes], weights: list[int], starts: list[int], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each phrase (words joined by a space; weight 2 if it occurs twice), which window starts are repeated."""
    (window,) = lengths
    automaton, ends = WordAutomaton(), []
    sequences = [p.split() for p in phrases]
    for words, weight in zip(sequences, weights, strict=True):
        last = 0
        for i, word in enumerate(words):
            last = automaton.extend(last, word)
            if i + 1 >= window:
                ends.append((last, weight))
    link, length, nxt = automaton.link, automaton.length, automaton.next
    count = [0] * len(nxt)
    for state, weight in ends:
        count[state] += weight
    for state in reversed(automaton.by_length()):
        if length[link[state]] >= window:
            count[link[state]] += count[state]
    out = []
    for words, weight in zip(sequences, weights, strict=True):
        mask = np.zeros(max(0, len(words) - window + 1), bool)
        state = 0
        for i, word in enumerate(words if weight == 1 else ()):
            state = nxt[state][word]
            while length[link[state]] >= window:
                state = link[state]
            if i + 1 >= window:
                mask[i + 1 - window] = count[state] >= 2
        out.append([mask])
    return out


WORDS = Kind((WINDOW,), TRIGGER, (8, 1), fp.word_symbols, bytes.split, b" ".join, repeated_windows)


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Words covered by repeated windows go; ``ranges`` and ``n`` count words, ``kept`` joins the rest by a space."""
    return remove_repeats(docs, WORDS, doc_id, text, keep_text)
