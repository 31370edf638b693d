"""The stages in order, against a brute-force version of what each must do."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from tidewell.llm import lshforest, sharding

from .test_near import classes, shingle_set
from .test_streams import ITEMS, brute, labelled


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, t, lang in labelled(150)]
    rows += [(300 + i, rows[i][1], rows[i][2], "s1", rows[i][4]) for i in range(20)]
    rows += [(400, "12 34", "aa", "s0", 5), (401, None, None, None, None), (402, "the and ing ion of to her " * 9 + ITEMS[0][1] + " tha ent", "aa", "s2", 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append({r.doc_id: r for r in docs.collect()})
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept[0]) == {r[0] for r in rows} - {400, 401}
    sets = {i: shingle_set(r.text) for i, r in kept[0].items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.PERCENT * len(sets[a] | sets[b])]
    assert set(kept[1]) == set(classes(sets, links).values())
    assert set(kept[2]) == set(kept[1])
    assert all(brute(r.text, ITEMS)[1] == 0 and r.n_chars == len(r.text) for r in kept[2].values())
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) > 0.4 * len(kept[2])
    table = sharding.lookup_table([f"shard-{i}" for i in range(sharding.SHARDS)])
    assert all(r.shard == table[r.slot] for r in kept[4].values()) and set(kept[4]) == set(kept[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.select("doc_id").collect()} == set(kept[4])


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_tables(spark, tmp_path, stage):
    """Each stage alone: an empty table, an empty benchmark, null and repeated ids, columns with names of its own."""
    work = dict(corpus_pipeline.STAGES)[stage]
    names = ("_key", "_text", "_row", "node", "component", "kept", "spans", "items", "n_words", "h1")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    texts = [t for _, t, _ in labelled(12)]
    rows = [(i if i else None, t, "aa", None, len(t), *names) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "aa", None, 1, *names), (None, None, None, None, None, *names), (20, "", "bb", "s", 0, *names)]
    for empty, table in ((True, []), (False, rows)):
        where = str(tmp_path / str(empty))
        items = spark.createDataFrame([] if empty else [(1, texts[5]), (None, "x"), (2, None)], "item_id long, text string")
        items.write.parquet(f"{where}/benchmark.parquet")
        spark.createDataFrame(table, schema).write.parquet(f"{where}/docs")
        found = work(spark, spark.read.parquet(f"{where}/docs"), where)
        assert found.columns[:15] == schema.replace(" long", "").replace(" string", "").split(", ")
        kept = found.collect()
        assert len(kept) <= len(table) and all(r[n] == n for r in kept for n in names)
        if stage != "language":
            assert empty or (sum(r.text is None for r in kept) == 1 and sum(r.text == "" for r in kept) == 1) or stage == "mixture"


def test_other_queries_keep_their_scratch(spark, tmp_path):
    """A result that is built, but not read yet, outlives the pipeline's stages."""
    rows = [(i, t, lang, "s", len(t)) for i, t, lang in labelled(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    waiting = lshforest.near_duplicates(docs)
    for name in ("near_duplicates", "mixture", "placement"):
        dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).count()
    assert waiting.count() == 20
