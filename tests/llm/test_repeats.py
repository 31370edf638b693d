"""Repeated passages over words and bytes, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tidewell.llm import repeats, substring, suffixarray


def brute(units, window):
    counts = Counter(u[i : i + window] for u in units for i in range(len(u) - window + 1))
    masks = []
    for u in units:
        mask = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            if counts[u[i : i + window]] > 1:
                mask[i : i + window] = True
        masks.append(mask)
    return masks


def texts():
    rng = random.Random(3)
    words = lambda n: [f"{rng.choice('abcdefghij')}{rng.randrange(400)}" for _ in range(n)]
    shared, other = words(60), words(200)
    out = [" ".join(words(rng.randrange(20, 120)) + shared[: rng.randrange(30, 60)] + words(rng.randrange(0, 50))) for _ in range(25)]
    base = words(150)
    for _ in range(25):
        near = list(base)
        near[rng.randrange(150)] = "edit"
        out.append(" ".join(near))
    # passages of 256 to 400 bytes, within texts and at their ends
    out += [" ".join(words(rng.randrange(5, 40)) + other[at : at + rng.randrange(50, 62)] + words(rng.randrange(0, 9))) for at in (0, 3, 70, 72, 140)]
    return [*out, " ".join(other), " ".join(other), "Zä ö\tü\n" * 80, "x" * 3000, "", None, "one", " ".join(words(40)) + " é" * 500]


def check(rows, values, kind, sliced):
    units = [sliced((v or "").encode()) for v in values]
    shorter = [m.sum() for m in brute(units, kind.lengths[-1])]
    for (doc_id, n, removed, spans, sha, repeated), unit, mask, short in zip(rows, units, brute(units, kind.window), shorter, strict=True):
        assert repeated == [int(mask.sum()), int(short)][: len(kind.lengths)], doc_id
        kept = [unit[i : i + 1] for i in range(len(unit)) if not mask[i]]
        joined = b"".join(kept) if isinstance(unit, bytes) else b" ".join(w for (w,) in kept)
        assert (n, removed) == (len(unit), int(mask.sum())), doc_id
        assert sha == hashlib.sha256(joined).hexdigest()
        assert spans == int((np.diff(mask.astype(int), prepend=0) == 1).sum())


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize(("kind", "sliced"), [(substring.WORDS, lambda b: tuple(b.split())), (suffixarray.BYTES, bytes)])
def test_equals_brute_force(spark, monkeypatch, kind, sliced, hot):
    if hot:  # every trigger and every core
        monkeypatch.setattr(repeats, "HOT", 1)
    values = texts()
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    found = repeats.remove_repeats(docs, kind).orderBy("doc_id").collect()
    check([(r.doc_id, r.n, r.n_removed, len(r.ranges), r.kept_sha256, r.repeated) for r in found], values, kind, sliced)


def test_repeated_and_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, "x", 5), (1, text, "y", 6), (None, text, "z", 7), (2, "short", None, 8)], "doc_id long, text string, spans string, n int")
    found = sorted((r.doc_id or -1, r.n_removed) for r in substring.remove_repeated_passages(docs).collect())
    assert found == [(-1, 50), (1, 50), (1, 50), (2, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeated_passages(docs).count() == 0
    assert suffixarray.remove_repeated_bytes(docs).count() == 0


def test_structures_agree():
    rng = random.Random(1)
    base = bytes(rng.choice(b"ab ") for _ in range(300))
    phrases = [base[i : i + 60] for i in range(0, 240, 7)]
    wide = suffixarray.repeated_windows(phrases, [1] * len(phrases), [45] * len(phrases), (20, 16))
    for k, n in enumerate((20, 16)):
        counts = Counter(p[i : i + n] for p in phrases for i in range(min(45, 61 - n)))
        assert all((m[k] == [counts[p[i : i + n]] > 1 for i in range(min(45, 61 - n))]).all() for m, p in zip(wide, phrases, strict=True))
    words = [b" ".join(base[i : i + 60].split()) for i in range(0, 240, 7)]
    masks = substring.repeated_windows(words, [1] * len(words), [60] * len(words), (5,))
    counts = Counter(tuple(p.split()[i : i + 5]) for p in words for i in range(len(p.split()) - 4))
    for (mask,), p in zip(masks, words, strict=True):
        assert mask.tolist() == [counts[tuple(p.split()[i : i + 5])] > 1 for i in range(len(mask))]


def test_long_text_is_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", 64)
    symbols = substring.WORDS.symbols(" ".join(f"w{i % 90}" for i in range(1000)).encode())
    a, c, s, m = repeats.phrases(symbols, substring.WORDS)
    assert m.sum() == 1000 - 34
    assert sorted(x for i, k in zip(s, m, strict=True) for x in range(i, i + k)) == list(range(966))


def test_one_very_long_text(spark, monkeypatch):
    """A text of several pieces, in which one passage stands twice, equals brute force."""
    monkeypatch.setattr(repeats, "_PIECE", 1000)
    rng = random.Random(9)
    words = [f"v{rng.randrange(10**6)}" for _ in range(20000)]
    values = [" ".join(words[:15000] + words[40:120] + words[15000:]), " ".join(words[19900:]), "z"]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    for kind, sliced in ((substring.WORDS, lambda b: tuple(b.split())), (suffixarray.BYTES, bytes)):
        found = repeats.remove_repeats(docs, kind).orderBy("doc_id").collect()
        check([(r.doc_id, r.n, r.n_removed, len(r.ranges), r.kept_sha256, r.repeated) for r in found], values, kind, sliced)
