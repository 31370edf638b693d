"""Near-duplicates of texts and vectors, and components, against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewell.llm import langid, lshforest, pq
from tidewell.llm.components import components


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    nodes = {x for pair in links for x in pair}
    truth = classes(nodes, links)
    assert all(found.get(n, n) == truth[n] for n in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def variants():
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    out = []
    for _ in range(12):
        base = words(rng.randrange(60, 200))
        out.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            for _ in range(rng.randrange(0, 4)):
                near[rng.randrange(len(near))] = "changed"
            out.append(" ".join(near))
    base = words(120)
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randrange(1, 3)):
            near[rng.randrange(len(near))] = f"x{rng.randrange(99)}"
        out.append(" ".join(near))
    return [*out, "a b c", "A  b\tC", "a b", None, "", " \n", " ".join(words(30000))]


def test_documents_equal_brute_force(spark):
    texts = variants()
    docs = spark.createDataFrame([(i + 10, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    sets = {i + 10: shingle_set(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    truth = classes(sets, links)
    for r in lshforest.near_duplicates(docs).collect():
        assert (r.component_id, r.n_shingles, r.kept) == (truth[r.doc_id], len(sets[r.doc_id]), truth[r.doc_id] == r.doc_id)


def test_dense_regions_are_settled(spark, monkeypatch):
    monkeypatch.setattr(lshforest, "REACH", 2)
    monkeypatch.setattr(lshforest, "NEAR", 1)
    monkeypatch.setattr(lshforest, "BLOCK", 16)
    test_documents_equal_brute_force(spark)


def near_80():
    """Pairs that share 0.80 to 0.85 of their shingles, and a dense region with members that fail their neighbours."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    out = []
    for _ in range(40):
        base = words(100)
        near = base[:]
        for k in (30, 70):
            near[k] = "changed"
        out += [" ".join(base), " ".join(near)]
    common = words(60)
    for _ in range(40):
        base = common + words(30)
        out += [" ".join(base), " ".join(base[:-4] + words(4))]
    return out


def test_eighty_percent_equals_brute_force(spark):
    texts = near_80()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    some = [(a, b) for a, b in links if 100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b])]
    assert len(some) >= 20
    truth = classes(sets, links)
    assert {r.doc_id: r.component_id for r in lshforest.near_duplicates(docs, percent=80).collect()} == truth
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(truth.values())
    assert (lshforest.orders_for(85), lshforest.orders_for(80)) == (16, 23)


def test_regions_run_on_over_partitions(spark, monkeypatch):
    """Pairs of one region in different partitions are candidates, and all of a dense region are of one family."""
    monkeypatch.setattr(lshforest, "REACH", 2)
    monkeypatch.setattr(lshforest, "NEAR", 1)
    rng = random.Random(3)
    start = bytes(lshforest.orders_for(85) * lshforest.DEPTH * 2 - 40)
    rows = [(i, start + rng.randbytes(40)) for i in range(90)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = [(r.a, r.b) for r in lshforest.candidates(spark.createDataFrame(rows, "node long, sign binary")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert set(classes(range(90), found).values()) == {0}


@pytest.mark.parametrize("parts", [1, 4, 200, 211])
def test_result_does_not_depend_on_partitions(spark, parts):
    texts = variants()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = {r.doc_id: r.component_id for r in lshforest.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found == classes(sets, links)


def test_documents_with_odd_ids(spark):
    docs = spark.createDataFrame([(7, "a b c d e f", "p"), (7, "a b c d e f", "q"), (None, "a b c d e f", "r"), (3, "other", None)], "doc_id long, text string, component string")
    found = lshforest.near_duplicates(docs).collect()
    assert sorted((r.component_id, r.kept) for r in found) == [(3, True), (7, False), (7, False), (7, True)]
    kept = lshforest.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.component for r in kept.filter("component is not null").collect())[0] in "pq"
    assert kept.count() == 2
    assert lshforest.near_duplicates(docs.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 24))
    groups = [base[i] + rng.normal(size=(8, 24)) * 0.22 * rng.uniform(0.5, 1.6) for i in range(40)]
    x = np.concatenate([base, *groups, base[:3], base[:2] * 2]).astype(np.float32)
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, "c"), (n + 1, [0.0] * 24, "c"), (n + 2, [float("nan")] + [1.0] * 23, "c"), (n + 3, [None] + [1.0] * 23, "c"), (n + 4, [1.0] * 5, "c"), (n + 5, [], "c"), (n + 6, [float("inf")] + [1.0] * 23, "c")]
    found = {r.doc_id: r for r in pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, weight string")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)]
    got = sum(found[i].n_links for i in range(n))
    assert 0.95 * len(links) <= got <= len(links)
    truth = classes(range(n), links)
    assert np.mean([found[i].component_id == truth[i] for i in range(n)]) > 0.98
    assert all((found[n + k].n_links, found[n + k].component_id, found[n + k].kept) == (0, n + k, True) for k in range(7))


def test_vectors_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert pq.near_vectors(spark.createDataFrame([], schema)).count() == 0
    one = pq.near_vectors(spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.1])], schema)).collect()
    assert sorted((r.n_links, r.component_id, r.kept) for r in one) == [(2, 5, False), (2, 5, False), (2, 5, True)]


def test_recall_at_the_threshold(spark):
    """Pairs at cosine 0.90 to 0.93, the hardest, among random vectors: recall against brute force."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1)[:, None] * a
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(0.901, 0.93, size=(1500, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * noise]).astype(np.float32)
    found = pq.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    assert found.groupBy().sum("n_links").first()[0] >= 0.95 * 3000


def test_a_dense_group_keeps_all_its_links(spark):
    """A third of the rows jittered around one vector, most of them linked, and two lengths: every count as by brute force."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8000, 64))
    hot = rng.normal(size=64) + rng.normal(size=(4000, 64)) * 0.3
    x = np.concatenate([base, hot]).astype(np.float32)
    other = x[7900:8100, :48].copy()
    table = [(i, v.tolist()) for i, v in enumerate([*x, *other])]
    found = {r.doc_id: r for r in pq.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<float>")).collect()}
    for part, first in ((x, 0), (other, len(x))):
        unit = part.astype(float) / np.linalg.norm(part.astype(float), axis=1)[:, None]
        near = unit @ unit.T >= 0.9
        np.fill_diagonal(near, False)
        assert near.sum() > len(part)
        assert [found[first + i].n_links for i in range(len(part))] == near.sum(1).tolist()


def test_bounds_leave_out_no_link():
    """Few bins, whose lists are far apart: pairs in bins that are not visited are all below the threshold."""
    rng = np.random.default_rng(5)
    x = pq._unit(np.repeat(rng.normal(size=(40, 16)), 50, axis=0) + rng.normal(size=(2000, 16)) * 0.2)
    index = pq.Index(x[::4], 30)
    squares = index.squares(x)
    own = squares.argmin(1)
    radius = np.sqrt(squares.min(1))
    names = np.unique(own).tolist()
    old, pq.BLOCK = pq.BLOCK, 60
    try:
        index.fill({k: int((own == k).sum()) for k in names}, {k: float(radius[own == k].max()) for k in names})
    finally:
        pq.BLOCK = old
    home = index.first[own] + np.arange(len(x)) % index.parts[own]
    bins, seen = index.reach(x, own, 0.2**0.5)
    assert bins.tolist() == list(range(len(bins))) and set(home.tolist()) == set(bins.tolist())
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert seen[i, home[j]].all() and not seen.all()


def test_codes_leave_out_no_link():
    """Distances added up from tables are those to the decoded vectors, and with a code's error never above the true ones."""
    rng = np.random.default_rng(6)
    x = pq._unit(np.repeat(rng.normal(size=(30, 24)), 40, axis=0) + rng.normal(size=(1200, 24)) * 0.25)
    index = pq.Index(x[::3], 20)
    own = index.squares(x).argmin(1)
    codes, shift, error = index.encode(x, own)
    decoded = index.coarse[own] + np.concatenate([book[codes[:, m]] for m, book in enumerate(index.books)], axis=1)
    found = index.distances(x[:100], own, codes, shift)
    true = ((decoded[:, None] - x[None, :100]) ** 2).sum(2)
    assert np.abs(found - true).max() < pq._SINGLE
    far = 0.2**0.5
    left_out = found > ((far + error + pq._SINGLE) ** 2 + pq._SINGLE)[:, None]
    linked = x @ x[:100].T >= 0.9
    assert not (left_out & linked).any() and left_out.mean() > 0.9 * (1 - linked.mean())


def test_thresholds_that_need_too_many_orders_are_refused():
    assert [lshforest.orders_for(p) for p in (100, 85, 80)] == [1, 16, 23]
    for percent in (60, 0):
        with pytest.raises(ValueError, match="orders"):
            lshforest.orders_for(percent)


def test_stages_keep_columns_of_any_name(spark):
    """Names that operators use themselves neither stop a stage nor lose their values."""
    text = "the quick brown fox jumps over the lazy dog and runs away again "
    names = ("_key", "_text", "_c0", "node", "component", "kept", "h1", "score", "bits", "lang_pred")
    docs = spark.createDataFrame([(i, text * (1 + i // 2), "en") for i in range(6)] + [(None, text, "en"), (7, None, None)], "id long, doc_id string, lang string")
    docs = docs.withColumns({n: F.lit(n) for n in names})
    kept = lshforest.keep_one(docs, "id", "doc_id")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert all(r[n] == n for r in rows for n in names)
    assert 7 in {r.id for r in rows} and None not in {r.id for r in rows}
    some = langid.recognised(docs, spark.createDataFrame([("en", text)], "lang string, text string"), 8.0, "doc_id")
    assert some.columns == docs.columns and some.count() == 7 and all(r[n] == n for r in some.collect() for n in names)
