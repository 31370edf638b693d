"""A corpus from raw documents to placed shards, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's documents. A stage drops the scratch tables of the one
before it, whose result has been written by then; other queries' tables are left alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontaminate, langid, lshforest, mixing, queries, sharding, storage
from tidewell.session import ship

#: Of shingles that two near-duplicates share.
PERCENT = 80
#: Closer to one than the operator's own default, and the share of tokens that is kept, whatever the rarest cell.
TEMPER, KEPT = 0.9, 0.9
#: Scratch tables of the stage before in this thread; its result has been written when the next one begins.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    @wraps(work)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        storage.forget(spark, _scratch.get() or [])
        with storage.scope() as made:
            out = work(spark, docs, sf_dir)
        _scratch.set(made)
        return out

    return begun


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go.

    Null texts, empty texts and texts of signs go; rows with null or repeated ids are judged by
    their texts alone; without any label nothing is learned and no row stays; columns of
    any names pass through. The limits are fitted on what labelled texts cost in their own and in other
    languages' references.
    """
    learned = langid.references(docs)
    return langid.recognised(docs, learned, langid.limits(learned))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Null, empty and wordless texts have no copies and stay; of repeated rows one stays, a null id
    only where no other row of the group has one; columns of any names pass through.
    """
    return lshforest.keep_one(docs, percent=PERCENT)


@_stage
def benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut from the texts; a document that is mostly benchmark goes.

    Null and empty texts stay as they are, repeated rows are cut alike; with an empty benchmark
    nothing is cut. ``n_chars`` is counted again where there is such a column.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items, n_chars="n_chars" if "n_chars" in docs.columns else None)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet tempered shares.

    Null sources and languages are values of their own; texts without tokens have their cell's
    probability; repeated ids share their fate; columns of any names pass through.
    """
    return mixing.mix(docs, queries.margins(docs), mixing.token_count(docs["text"]), temper=TEMPER, kept=KEPT)


@_stage
def placement(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its ``slot`` and ``shard`` by its id; a column of one of these names gives way. Null ids share a shard."""
    return sharding.shard(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_spans", benchmark_spans),
    ("mixture", mixture),
    ("placement", placement),
]
#: No SQL: the first two stages stream texts through automata and compare signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{storage.shared_folder(spark)}/tidewell/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}")
        if k:
            storage.forget(spark, [f"{base}/{k - 1}"])
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
