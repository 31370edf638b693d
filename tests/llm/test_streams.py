"""Decontamination, languages, mixing and placement."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tidewell.llm import decontaminate, langid, mixing, sharding

ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (2, "short item here"), (3, None), (None, "a b c"), (4, "..."), (5, "the QUICK brown fox jumps over the lazy dog again")]


def brute(text, items, window=10):
    words = decontaminate.words_of(text.encode() if text else None)
    hit, names = set(), set()
    for item, body in items:
        unit = decontaminate.words_of(body.encode() if body and item is not None else None)
        k = min(window, len(unit))
        for i in range(len(unit) - k + 1) if k else ():
            for j in range(len(words) - k + 1):
                if words[j : j + k] == unit[i : i + k]:
                    hit |= set(range(j, j + k))
                    names.add(str(item))
    return len(words), len(hit), sorted(names)


def documents():
    rng = random.Random(1)
    vocabulary = "the quick brown fox jumps over lazy dog again and today short item here".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    return [*texts, "x THE quick, brown fox jumps over the lazy dog again and again today!", "Short-item HERE é", "", None, "...", "fox " * 5000]


@pytest.mark.parametrize("block_words", [100_000, 8])
def test_matches_equal_brute_force(spark, block_words):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(documents())], "doc_id long, text string, spans string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.matches(docs, items, block_words=block_words).collect()}
    assert len(found) == docs.count()
    for i, text in enumerate(documents()):
        n, hit, names = brute(text, ITEMS)
        assert (found[i].n_words, sum(s.end - s.start for s in found[i].spans), found[i].items) == (n, hit, names)


@pytest.mark.parametrize("block_words", [100_000, 8])
def test_cut_texts_have_no_window_left(spark, block_words):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(documents())] + [(99, "clean words " * 30 + ITEMS[0][1] + ". More clean words", 0)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.decontaminate(docs, items, n_chars="n_chars", block_words=block_words)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert all(brute(r.text, ITEMS)[1] == 0 for r in rows.values())
    assert rows[99].text.startswith("clean words clean") and rows[99].text.endswith(". More clean words") and rows[99].n_chars == len(rows[99].text)
    assert rows[43].text is None and 41 not in rows


def test_blocks_cut_as_one(spark):
    """A text that loses 40% to each of several items goes, and a window that forms where another block's cut joins words is cut."""
    words = [f"q{k}" for k in range(60)]
    items = [(k, " ".join(words[12 * k : 12 * k + 12])) for k in range(5)]
    rest = [f"z{k}" for k in range(6)]
    texts = [" ".join([*rest, items[a][1], *rest[:2], items[b][1]]) for a in range(5) for b in range(5) if a != b]
    nested = [" ".join(["clean"] * 60 + words[12 * a : 12 * a + 6] + items[b][1].split() + words[12 * a + 6 : 12 * a + 12]) for a in range(5) for b in range(5) if a != b]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate([*texts, *nested, None])], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = ({r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, n_chars="n_chars", block_words=k).collect()} for k in (100_000, 15))
    assert many == one and set(one) == set(range(len(texts), len(texts) + len(nested) + 1))
    assert all(t is None or set(t.split()) == {"clean"} for t in many.values())


def test_empty_inputs(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.items for r in decontaminate.matches(docs, none).collect()] == [[]]
    assert decontaminate.matches(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def labelled(n=240):
    rng = random.Random(9)
    parts = {"aa": "the and ing ion of to her tha ent".split(), "bb": "der und sch ein cht ich keit ung".split(), "cc": "que les ment eau tre oux est aient".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((i, text, lang))
    return rows


def texts(learned):
    return {r.lang: r.text for r in learned.collect()}


def test_languages_on_held_out_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !?", "aa"), (902, "", None), (903, "thething " * 20000, "aa")], "doc_id long, text string, lang string")
    learned = langid.references(docs)
    assert sorted(texts(learned)) == ["aa", "bb", "cc"]
    assert all(len(t) <= langid.PIECES * (langid.PIECE_CHARS + 1) for t in texts(learned).values())
    found = {r.doc_id: r for r in langid.identify(docs, learned, keep=["doc_id"]).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert [(found[i].lang_pred, found[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert found[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found.values())
    flags = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in flags)


def test_predictions_equal_brute_force(spark):
    """Languages, scores and bits of a whole table, repeated rows and an unlearned language among it, by parsing with substring tests."""
    rows = [(i, t[:200], lang) for i, t, lang in labelled(60)]
    rows += [(100, rows[0][1], None), (100, rows[0][1], None), (101, "zq zq wx", "zz"), (102, "Été ÉTÉ 5 the", "aa"), (103, "é", None), (None, "the und que", "bb"), (104, "", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.references(docs)

    def folded(text):
        return re.sub("0+", "0", "".join(c.lower() if c.isalpha() else "0" for c in text))

    refs = {k: folded(t) for k, t in texts(learned).items()}
    want = []
    for i, text, _ in rows:
        x, costs = folded(text), {}
        for name, ref in refs.items():
            at = phrases = 0
            while at < len(x):
                end = at + 1
                while end < len(x) and x[at : end + 1] in ref:
                    end += 1
                at, phrases = end, phrases + 1
            costs[name] = phrases * math.log2(max(2, len(ref))) / max(1, len(x))
        best, second = (sorted(costs.items(), key=lambda c: (c[1], c[0])) * 2)[:2]
        some = any(c.isalpha() for c in text)
        want.append((i, best[0] if some else "und", round(1 - best[1] / second[1], 9) if some else 0.0))
    for block in (64, 1, 2):
        found = langid.identify(docs, learned, keep=["doc_id"], block=block).collect()
        assert sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in found), key=str) == sorted(want, key=str)


def test_scripts_of_high_code_points(monkeypatch):
    """Two languages of 400 ideographs, after another's letters: told apart, by tables and by sorted transitions alike."""
    rng = random.Random(7)
    scripts = {"a": "".join(chr(0x100 + k) for k in range(60)) * 3 + "".join(chr(0x1400 + k) for k in range(300))}
    scripts |= {k: "".join(chr(0x4E00 + start + rng.randrange(200)) for _ in range(3000)) for k, start in (("x", 0), ("y", 200))}
    probe = [scripts["x"][500:560], scripts["y"][500:560]]
    seen, bits = langid.Parser(scripts).entropies(probe)
    assert bits.argmin(axis=1).tolist() == [1, 2] and seen.all()
    monkeypatch.setattr(langid, "TABLES", 0)
    assert (langid.Parser(scripts).entropies(probe)[1] == bits).all()


def test_more_than_64_labels(spark):
    rng = random.Random(8)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(9)] for k in range(70)}
    rows = [(100 * k + i, " ".join(rng.choice(words[name]) for _ in range(30)), name) for k, name in enumerate(words) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.references(docs)
    assert set(texts(learned)) == set(words)
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, learned, keep=["doc_id"]).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


@pytest.mark.parametrize("away", ["aa", "bb", "cc", None])
def test_texts_in_no_learned_language_go(spark, away):
    """Whichever label is left out, its texts go, and so do shuffled letters and hexadecimal digits; own texts, short ones too, stay, and a rare label lets none in."""
    rows = labelled(900)
    rng = random.Random(4)
    junk = [(2000 + i, "".join(rng.sample(t, len(t))), lang) for i, t, lang in rows[:150]] + [(3000 + i, "".join(rng.choice("0123456789abcdef") for _ in range(64)), "aa") for i in range(50)]
    docs = spark.createDataFrame([*rows, *junk, (4000, "ab cd", "rare")], "doc_id long, text string, lang string")
    learned = langid.references(docs.filter((F.col("doc_id") < 2000) | (F.col("doc_id") == 4000)).filter(F.col("lang") != (away or "")))
    limits = langid.limits(learned)
    labels = {"aa", "bb", "cc"} - {away}
    assert set(texts(learned)) == labels | {"rare"} and {r.lang for r in limits.collect()} == labels
    kept = {r.doc_id for r in langid.recognised(docs, learned, limits).collect()}
    own = {i for i, _, lang in rows if lang != away}
    assert len(own & kept) >= 0.98 * len(own)
    far = {i for i, t, lang in rows if lang == away and len(t) > 20}
    assert len(far & kept) <= 0.05 * max(1, len(far))
    assert len(kept & {i for i, t, _ in junk if len(t) > 20}) <= 0.05 * len(junk)
    assert {r.doc_id for r in langid.recognised(docs, learned, limits, block=1).collect()} == kept


def test_limits_of_one_language(spark):
    rows = [(i, t, "aa") for i, t, lang in labelled(900) if lang == "aa"]
    others = [(5000 + i, t, None) for i, t, lang in labelled(300) if lang == "bb" and len(t) > 40]
    docs = spark.createDataFrame(rows + others, "doc_id long, text string, lang string")
    learned = langid.references(docs)
    kept = {r.doc_id for r in langid.recognised(docs, learned, langid.limits(learned)).collect()}
    assert len(kept & {i for i, _, _ in rows}) >= 0.98 * len(rows) and len(kept & {i for i, _, _ in others}) <= 0.05 * len(others)
    few = langid.references(docs.limit(2))
    assert langid.limits(few).count() == 0 and langid.recognised(docs, few, langid.limits(few)).count() == docs.count()


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    none, one = langid.references(docs), spark.createDataFrame([("aa", "abc")], "lang string, text string")
    assert none.count() == 0
    assert langid.identify(docs, none).first().lang_pred == "und"
    assert langid.identify(docs.limit(0), one).count() == 0
    assert langid.recognised(docs, none, 9.0).count() == 0 and langid.recognised(docs, none, langid.limits(none)).count() == 0
    clash = langid.identify(docs.withColumn("score", F.lit("x")), one)
    assert clash.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits"] and clash.first().score == 1.0


def test_parse_is_greedy():
    parser = langid.Parser({"x": "banana bandana", "y": "zzzz"})

    def count(text, ref):
        n = 0
        while text:
            k = max([i for i in range(1, len(text) + 1) if text[:i] in ref], default=1)
            text, n = text[k:], n + 1
        return n

    seen, bits = parser.entropies(["bandanabanana", None, "zzzzz"])
    assert seen.tolist() == [True, False, True]
    assert bits[0, 0] == pytest.approx(count("bandanabanana", "banana bandana") * parser.bits[0] / 13)
    assert bits[2, 1] == pytest.approx(count("zzzzz", "zzzz") * parser.bits[1] / 5)


def test_raking_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, f"s{min(i % 7, rng.randrange(5))}", rng.choice("xyz"), "w " * rng.randrange(1, 30)) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (None, None, "x", None), (None, "s1", None, "")], "doc_id long, source string, lang string, text string")
    margins = {"source": docs["source"], "lang": docs["lang"]}
    tokens = mixing.token_count(docs["text"])
    goal = spark.createDataFrame([("x", 0.2), ("y", 0.3), ("z", 0.5)], "value string, share double")
    fitted = mixing.rake(docs, margins, tokens, {"lang": goal}, rounds=12)
    total = fitted.agg(F.sum("_w")).first()[0]
    shares = {r["_m1"]: r[1] / total for r in fitted.groupBy("_m1").agg(F.sum("_w")).collect()}
    assert shares["x"] == pytest.approx(0.2, abs=1e-6) and shares["z"] == pytest.approx(0.5, abs=1e-6)
    source = fitted.groupBy("_m0").agg(F.sum("_n").alias("n"), F.sum("_w").alias("w")).filter("n > 0").collect()
    norm = sum(r.n**mixing.TEMPER for r in source)
    assert all(r.w / total == pytest.approx(r.n**mixing.TEMPER / norm, abs=1e-3) for r in source)
    assert fitted.agg(F.max("_p")).first()[0] == pytest.approx(1.0)
    kept = mixing.mix(docs, margins, tokens, targets={"lang": goal})
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, mixing.mix(docs, margins, tokens, targets={"lang": goal}).collect()))
    words = {r.lang: r.n for r in kept.groupBy("lang").agg(F.sum(mixing.token_count(F.col("text"))).alias("n")).collect()}
    assert words["z"] / sum(words.values()) == pytest.approx(0.5, abs=0.06)
    clash = docs.withColumns({n: F.lit("x") for n in ("_m0", "_p", "_n", "_row", "_u")})
    named = mixing.mix(clash, {"source": clash["source"], "lang": clash["lang"]}, tokens, targets={"lang": goal}, probability="_p")
    assert named.columns == [*[c for c in clash.columns if c != "_p"], "_p"]
    assert {r._m0 for r in named.collect()} == {"x"} and named.count() == kept.count()
    empty = docs.limit(0)
    assert mixing.mix(empty, {"source": empty["source"]}, mixing.token_count(empty["text"])).count() == 0


def test_one_rare_document_costs_no_others(spark):
    """With a share to keep, a label of one short document is kept whole, and the rest meets its targets."""
    rows = [(i, "ab"[i % 10 < 3], "xyz"[i % 7 % 3], "w " * (5 + i % 20)) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (9000, "a", "junk", "w w w w w")], "doc_id long, source string, lang string, text string")
    margins = {"source": docs["source"], "lang": docs["lang"]}
    fitted = mixing.rake(docs, margins, mixing.token_count(docs["text"]), temper=0.9, kept=0.9).collect()
    total = sum(r["_n"] for r in fitted)
    assert sum(r["_n"] * r["_p"] for r in fitted) == pytest.approx(0.9 * total, rel=0.002)
    assert [r["_p"] for r in fitted if r["_m1"] == "junk"] == [pytest.approx(1.0)]
    for m in ("_m0", "_m1"):
        have = {v: sum(r["_n"] for r in fitted if r[m] == v) for v in {r[m] for r in fitted}}
        norm = sum(n**0.9 for v, n in have.items() if v != "junk")
        for v in have.keys() - {"junk"}:
            now = sum(r["_n"] * r["_p"] for r in fitted if r[m] == v)
            assert now == pytest.approx(min(have[v], 0.9 * total * have[v] ** 0.9 / norm), rel=0.01)
    assert mixing.mix(docs, margins, mixing.token_count(docs["text"]), temper=0.9, kept=0.9).count() > 0.87 * docs.count()
    # sums by joins, as for very many cells, give the same
    joined = mixing.rake(docs, margins, mixing.token_count(docs["text"]), temper=0.9, kept=0.9, few=0).collect()
    key = lambda r: (r["_m0"], r["_m1"])
    for a, b in zip(sorted(fitted, key=key), sorted(joined, key=key), strict=True):
        assert key(a) == key(b) and b["_p"] == pytest.approx(a["_p"], abs=1e-9) and b["_off"] == pytest.approx(a["_off"], abs=1e-9)
    assert fitted[0]["_off"] < 0.01
    empty = docs.limit(0)
    assert mixing.mix(empty, {"lang": empty["lang"]}, mixing.token_count(empty["text"]), kept=0.9).count() == 0


def test_lookup_table_by_turns():
    names = [f"n{i}" for i in range(5)]
    table = sharding.lookup_table(names, 101)

    def walk(name):
        h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
        return [(h(f"{name}:offset") % 101 + j * (h(f"{name}:skip") % 100 + 1)) % 101 for j in range(101)]

    taken, walks, turn = {}, [iter(walk(n)) for n in names], 0
    while len(taken) < 101:
        slot = next(s for s in walks[turn % 5] if s not in taken)
        taken[slot], turn = turn % 5, turn + 1
    assert table == [taken[i] for i in range(101)]
    assert {table.count(k) for k in range(5)} <= {20, 21}
    fewer = sharding.lookup_table(names[:4], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 50
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_placement(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(2000)] + [(None, None), (None, "u")], "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    table = sharding.lookup_table([f"shard-{i}" for i in range(sharding.SHARDS)])
    assert all(r.shard == table[r.slot] for r in rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert len({r.shard for r in rows}) == sharding.SHARDS
    assert sharding.shard(docs.limit(0)).count() == 0
    clash = sharding.shard(docs.withColumns({"slot": F.lit("x"), "shard": F.lit("y")}))
    assert sorted(map(str, clash.collect())) == sorted(map(str, rows))
    assert sorted(map(str, sharding.shard(docs.select("doc_id"), slot="doc_id").select("shard").collect())) == sorted(f"Row(shard={r.shard})" for r in rows)


def test_raking_ends_when_it_has_converged(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"l{(i * i) % 4}", 1 + i % 17) for i in range(400)], "doc_id long, source string, lang string, n long")
    calls, real = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name: calls.append(name) or real(df, name))
    targets = {"source": spark.createDataFrame([("s0", 0.5), ("s1", 0.3), ("s2", 0.2)], "value string, share double"), "lang": spark.createDataFrame([("l0", 0.4), ("l1", 0.6)], "value string, share double")}
    fitted = mixing.rake(docs, {"source": docs["source"], "lang": docs["lang"]}, docs["n"], targets, rounds=50, tolerance=1e-6)
    assert calls.count("fitted") < 50
    off = mixing.residuals(fitted, {"_m0": targets["source"], "_m1": targets["lang"]}).collect()
    assert len(off) >= 5 and max(r.off for r in off) <= 1e-6
