"""URL filters, ranked search and manifests against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewell.llm import merkle, queries, ranking, urlfilter

RULES = [urlfilter.Rule(*r) for r in queries.RULES]
URLS = [
    "https://A.Example.ORG/es/1?x=1#f", "http://example.org/en/12", "http://example.org/en/2", "x://b.org", "x://b.org/", "http://COM/fr/1", "http://notcom/de/1", "http://a.com/de/", "http://a.com/DE/",
    "://com/de/?", "http://a.com?/de/", "http://a.com#/fr/", "no address", "", None, "http://", "http:///", "http://a.net/x://com/de/", "http://www.a.net:80/index.html?b=2&utm_source=q&a=1#t", "https://a.net/?a=1&b=2",
    "http://É.example.org/es/é", "http://a.net/" + "/" * 50_000, "http://a.net/" + "x" * 100_000, "http://a\nb.com/fr/\n",
]


def ascii_lower(text):
    return text and "".join(c.lower() if c.isascii() else c for c in text)


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return ascii_lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def judged(url, listed):
    host, path = parts(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "block" if url in listed else "allow"


@pytest.mark.parametrize(("bits", "most"), [(12, 1 << 20), (1, 1 << 20), (12, 0)])
def test_urls_against_rules_and_list(spark, bits, most):
    many = [f"http://h{i}.net/p{i % 7}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS + many + many[:1] * 50)] + [(None, URLS[0], "n")], "page_id long, url string, host string")
    listed = {u for i, u in enumerate(many) if i % 3 == 0} | {"http://a.com/DE/"}
    table = spark.createDataFrame([(u.replace("http://", "https://www.") + "?utm_x=1",) for u in listed] + [(None,), ("",)], "url string")
    rows = urlfilter.judge(pages, RULES, table, bits=bits, most_blocks=most).collect()
    assert len(rows) == len(URLS) + 351
    text = {r.page_id: r.url for r in pages.collect()}
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judged(text[r.page_id], listed)
        assert r.listed <= r.possible
    passed = sum(r.possible and not r.listed for r in rows)
    assert (passed < 20) if bits == 12 and most else passed > 20


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string").select(urlfilter.canonical(F.col("url")))
    found = dict(zip(URLS, [r[0] for r in df.collect()], strict=True))
    assert found[URLS[18]] == found[URLS[19]] == "a.net?a=1&b=2"
    assert found[None] is None and found["http://"] is None and found["no address"] is None and found[URLS[21]] == "a.net"


def test_urls_of_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.net")], "page_id long, url string")
    assert urlfilter.judge(none, RULES, some).count() == 0
    assert [r.verdict for r in urlfilter.judge(some, [], none).collect()] == ["allow"]
    with pytest.raises(ValueError, match="distinct"):
        urlfilter.rule_of(F.col("host"), F.col("path"), [RULES[0], RULES[0]])


def words(text):
    return [ascii_lower(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k):
    texts = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in texts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    holding = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        query = Counter(words(text))
        scores = []
        for (doc, c), size in zip(texts, sizes, strict=True):
            m = 75 + (25 * size * n) // total if size else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in query.items() if c[t])
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [20_000, 12])
def test_ranks_against_all_scores(spark, block_words):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(200 + i, docs[3][1].upper()) for i in range(40)] + [(3, docs[3][1]), (None, docs[3][1]), (900, None), (901, ""), (902, "!? ."), (903, "é W1 😀w1, w2 " * 3000)]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(8)) + " w1 W1") for i in range(12)] + [("3", docs[3][1]), ("none", None), ("gone", "unheard of"), (None, "w1 é"), ("3", "w2")]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(3)
    found = ranking.top(table, spark.createDataFrame(items, "item_id string, text string"), k=7, block_words=block_words)
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()], key=str) == ranked(docs, items, 7)


def test_ranks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.top(docs.limit(0), items).count() == 0 and ranking.top(docs, items.limit(0)).count() == 0
    # a term that every document holds weighs 0: ln((2 + 2) / (2 + 1)) does not
    assert [tuple(r) for r in ranking.top(docs, items).collect()] == [(1, 1, 1, ranking.weight(1, 1) * (10**9 // (1000 + 12 * 100)))]


def test_a_search_stops_below_the_last_score():
    rng = np.random.default_rng(1)
    docs, vocabulary = 4000, 40
    lengths = np.full(docs, 4)
    ids = np.concatenate([np.sort(rng.choice(vocabulary, 4, replace=False)) for _ in range(docs)])
    times = rng.geometric(0.5, docs * 4)
    shard = ranking.ShardIndex(np.arange(docs), np.zeros(docs, bool), rng.integers(4, 400, docs), lengths, ids, times, vocabulary, (docs, docs * 100))
    best = ranking.Best(5)
    scored = shard.search(0, np.array([1, 2, 3]), np.array([900, 700, 800]), best)
    every = shard.forward[:, [1, 2, 3]].astype(np.int64) @ np.array([900, 700, 800])
    order = np.lexsort((np.arange(docs), -every))[:5]
    assert list(best.score) == list(every[order]) and list(best.doc) == list(order) and scored < 0.8 * (every > 0).sum()
    # what is known from earlier shards makes the next stop sooner
    again = ranking.Best(5)
    again.add(np.full(5, 10**10), np.arange(5), np.zeros(5, bool))
    assert shard.search(1, np.array([1, 2, 3]), np.array([900, 700, 800]), again) < scored


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def folds(nodes, fanout):
    """(top, for each node its siblings a level as (before, after))."""
    paths = [[] for _ in nodes]
    spans = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(a, min(a + fanout, len(nodes)))) for a in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for leaf in spans[k]:
                    paths[leaf].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
        spans = [[leaf for k in run for leaf in spans[k]] for run in runs]
        nodes = [sha(*[nodes[k] for k in run]) for run in runs]
    return nodes[0], paths


def manifest(rows, fanout, tampered):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    out, tops = [], []
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        leaves = [((r["doc_id"] is not None, r["doc_id"] or 0, sha(*[field(r[f]) for f in merkle.FIELDS])), r) for r in by[name]]
        leaves.sort(key=lambda x: x[0])
        top, paths = folds([x[0][2] for x in leaves], fanout)
        tops.append(top)
        out += [(name, x[0][2], p, x[1]) for x, p in zip(leaves, paths, strict=True)]
    root, above = folds(tops, fanout)
    found = []
    for name, leaf, path, r in out:
        path = path + above[names.index(name)]
        start = sha(*[field(ascii_lower(r[f]) if f == "text" else r[f]) for f in merkle.FIELDS]) if tampered(r) else leaf
        h = start
        for before, after in path:
            h = sha(*before, h, *after)
        found.append((r["doc_id"], leaf, tops[names.index(name)], root, sha(*[s for before, after in path for s in before + after]), h, h == root))
    return sorted(found, key=str)


@pytest.mark.parametrize("fanout", [16, 2])
def test_manifests(spark, fanout):
    rng = random.Random(5)
    sizes = {"hot": 273, "one": 1, "sixteen": 16, "é": 17, "": 33, None: 18, **{f"s{i}": 1 for i in range(20)}}
    rows = [{"doc_id": 0, "source": s, "lang": rng.choice(["en", None]), "n_chars": rng.choice([None, 7]), "text": rng.choice(["Abc", "abc", "", None, "É 😀", "x" * 5000 + "Y"])} for s, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    for i, r in enumerate(rows):
        r["doc_id"] = i - 5
    rows += [dict(rows[0]), dict(rows[0]), {**rows[1], "doc_id": None}, {**rows[2], "text": "other"}]
    table = spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, h string").repartition(5)
    lower = F.translate("text", urlfilter.UPPER, urlfilter.LOWER)
    found = merkle.manifest(table, tampered={"text": lower}, where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, fanout=fanout).collect()
    hit = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    assert sorted([tuple(r) for r in found], key=str) == manifest(rows, fanout, hit)
    assert {r.verified for r in found} == {True, False}
    assert all(r.verified for r in merkle.manifest(table, fanout=fanout).collect())


def test_small_manifests(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = spark.createDataFrame([(1, None, None, None, None)], schema)
    leaf = sha("1:1", "-", "-", "-", "-")
    assert [tuple(r) for r in merkle.manifest(one).collect()] == [(1, leaf, leaf, leaf, sha(), leaf, True)]
    assert merkle.manifest(one.limit(0)).count() == 0
