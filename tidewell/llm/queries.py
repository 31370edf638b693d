"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontaminate, langid, lshforest, merkle, mixing, oracles, pii, pq, ranking, secretscan, sharding, spans, substring, suffixarray, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_kind(column: str, kind: str) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_table(spark, sf_dir, "documents"))
    counts = [_of_kind("findings", r.name) for r in secretscan.RULES]
    every = spans.joined(F.col("findings"))
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(every, 256).alias("base_sha256"), every.alias("spans"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def margins(docs: DataFrame) -> dict:
    return {"source": docs["source"], "lang": docs["lang"], "topic": mixing.topic_of(docs["text"])}


#: Of all tokens, what the query keeps.
KEPT = 0.9


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = mixing.mix(docs, margins(docs), mixing.token_count(docs["text"]), probability="probability", residual="residual", kept=KEPT)
    return kept.select("doc_id", "source", "lang", F.round("probability", 9).alias("probability"), F.round("residual", 9).alias("residual"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixarray.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", F.size("ranges").cast("long").alias("n_spans"), "kept_sha256", F.get("repeated", F.lit(1)).alias("n_passage"))


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [_of_kind("base", k) for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents").select("doc_id"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pq.near_vectors(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("doc_id").alias("vec_id"), "n_links", "component_id", "kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.references(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: The rules of the query, and marks that a page of garbage holds.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
GARBAGE = ("%%%", "$$$", "***")


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs of pages of garbage: every variant of their URLs is blocked."""
    pages = _table(spark, sf_dir, "pages")
    listed = pages.filter(reduce(lambda a, mark: a & pages["html"].contains(mark), GARBAGE[1:], pages["html"].contains(GARBAGE[0])))
    found = urlfilter.judge(pages, [urlfilter.Rule(*r) for r in RULES], listed)
    return found.select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lower = F.translate("text", urlfilter.UPPER, urlfilter.LOWER)
    return merkle.manifest(docs, tampered={"text": lower}, where=F.crc32(docs["doc_id"].cast("string")) % 5 == 0)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secrets": op2_secrets,
    "op3_substrings": op3_substrings,
    "op4_mixing": op4_mixing,
    "op5_suffix_array": op5_suffix_array,
    "op6_personal": op6_personal,
    "op7_sharding": op7_sharding,
    "op8_embeddings": op8_embeddings,
    "op9_language": op9_language,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_urls": op11_urls,
    "op12_ranked": op12_ranked,
    "op13_merkle": op13_merkle,
}
SQL: dict[str, str] = oracles.SQL
