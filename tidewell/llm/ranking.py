"""Ranked lexical search by Fagin's threshold algorithm, for a set of items against all documents.

Documents are read once a block of items into a forward index (documents' terms among the block's
words, and their occurrences), written to the shared folder; document frequencies are aggregates of
it. Every task then takes its part of the index in shards of bounded memory. A shard has a list of
documents for each term, by falling impact, and its forward index in memory: an item goes down its
lists round-robin, each document met is scored whole by look-ups in the forward index, and the item
stops when the threshold - what a document not yet met could reach at most - falls strictly below its
k-th score. The k best of a task's earlier shards carry over, so later shards stop sooner. A task
gives back k rows an item at most; the best of these are the result, as the statistics are
those of the whole corpus. Documents are never shuffled, and a lost executor repeats its own shards.

Items are dealt to blocks of about ``block_words`` words, so the broadcast words and a shard's
index have a bound; several blocks read the documents once each.

Defined results: a null, empty or termless text is never found and counts nowhere; a null item
or one without terms has no rows; repeated documents and items stand for themselves, each item row
with ranks of its own (items of one id give one list each); a null doc_id sorts first among equal
scores; an empty table on either side gives no rows; terms in every document may weigh 0 and are then no hit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import words_of
from .storage import Shared, slices, written

TOP = 20
BLOCK_WORDS = 20_000
#: Cells of a shard's forward index, of four bytes.
CELLS = 12_000_000
#: Documents of a shard at most.
SHARD = 8192
#: Postings of each list that the first round takes; each round takes twice as many.
FIRST_ROUND = 16
#: Groups in which task results are cut to the k best before they meet.
GROUPS = 64


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, item_id, text) to (item, item_id, terms, times, n)."""
    for batch in slices(batches):
        terms, times, n = [], [], []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            found = Counter(words_of(text))
            terms.append(list(found))
            times.append(list(found.values()))
            n.append(sum(found.values()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["item", "item_id", "terms", "times", "n"])


def _index(shared: Shared):
    """Rows (doc_id, text) to the forward index (doc_id, n, ids, times), ids ascending; texts without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in slices(batches):
            at, n, ids, times = [], [], [], []
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                if words:
                    found = Counter([number[w] for w in words if w in number])
                    at.append(k)
                    n.append(len(words))
                    ids.append(sorted(found))
                    times.append([found[t] for t in ids[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "n", "ids", "times"])

    return run


class Best:
    """The k best (score, doc_id) so far; of equal scores the smaller ids, null first."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.empty(0, np.int64)
        self.doc = np.empty(0, np.int64)
        self.null = np.empty(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        if len(self.score) == self.k:
            some = score >= self.score[-1]
            score, doc, null = score[some], doc[some], null[some]
        if not len(score):
            return
        score, doc, null = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((doc, ~null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]

    def last(self) -> int:
        """The k-th score, 0 while there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else 0


class ShardIndex:
    """Documents by falling impact for each term, and the impacts of each document by term."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, n: np.ndarray, lengths: np.ndarray, ids: np.ndarray, times: np.ndarray, words: int, total: tuple[int, int]):
        docs, all_terms = total
        self.doc, self.null = doc, null
        row = np.repeat(np.arange(len(doc)), lengths)
        m = 75 + (25 * n * docs) // all_terms
        impact = (1_000_000_000 * times) // (1000 * times + 12 * m[row])
        self.forward = np.zeros((len(doc), words), np.int32)
        self.forward[row, ids] = impact
        order = np.lexsort((row, -impact, ids))
        self.row, self.impact = row[order], impact[order]
        self.starts = np.searchsorted(ids[order], np.arange(words + 1))
        self.met = np.full(len(doc), -1, np.int64)

    def search(self, item: int, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Adds to the best; returns how many documents were scored."""
        lo, hi = self.starts[terms], self.starts[terms + 1]
        terms, weights, lo, hi = (x[hi > lo] for x in (terms, weights, lo, hi))
        depth, step, scored = 0, FIRST_ROUND, 0
        while len(terms):
            # one round: the next `step` postings of every list
            at = lo[:, None] + np.arange(depth, depth + step)
            found = np.unique(self.row[at[at < hi[:, None]]])
            found = found[self.met[found] != item]
            self.met[found] = item
            scored += len(found)
            score = self.forward[found][:, terms].astype(np.int64) @ weights
            some = score > 0
            best.add(score[some], self.doc[found[some]], self.null[found[some]])
            depth, step = depth + step, step * 2
            left = hi - lo > depth
            threshold = int((self.impact[lo[left] + depth - 1] * weights[left]).sum())
            if not left.any() or threshold < best.last():
                break
        return scored


def _search(shared: Shared):
    """Forward index rows to (item, doc_id, score), k an item at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, words, total, k = shared.value
        best = {item: Best(k) for item, _, _ in items}
        most = max(64, min(SHARD, CELLS // max(1, words)))
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for at in range(0, table.num_rows, most):
                doc, n, ids, times = (table.column(i).slice(at, most).combine_chunks() for i in range(4))
                ids, times = ids if isinstance(ids, pa.Array) else ids.chunk(0), times if isinstance(times, pa.Array) else times.chunk(0)
                lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
                shard = ShardIndex(doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), lengths, ids.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64), words, total)
                for item, terms, weights in items:
                    shard.search(item, terms, weights, best[item])

        for batch in slices(batches, most):
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                flush()
        if held:
            flush()
        for item, _, _ in items:
            b = best[item]
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.score), pa.int64()), pa.array(b.doc, pa.int64(), mask=b.null), pa.array(b.score, pa.int64())], ["item", "doc_id", "score"])

    return run


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def _cut(rows: DataFrame, k: int, *by) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item; ``doc_id`` is a whole number."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    source = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    fields = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind), *T._parse_datatype_string("terms array<binary>, times array<bigint>, n bigint").fields])
    wanted = written(source.mapInArrow(_terms, fields).filter("n > 0"), "items")
    words = wanted.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for block in range(blocks):
        part = _of_block(rows, wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), k)
        part = written(part, "ranked") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found.join(wanted.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _of_block(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The best of the items of one block, which is bounded and so may stand on the driver."""
    spark = docs.sparkSession
    block = [(r["item"], [bytes(t) for t in r["terms"]], r["times"]) for r in wanted.collect()]
    number = {w: i for i, w in enumerate(sorted({t for _, terms, _ in block for t in terms}))}
    forward = written(docs.mapInArrow(_index(Shared(spark, number)), "doc_id bigint, n bigint, ids array<int>, times array<int>"), "forward")
    total = forward.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holding = {r["id"]: r["count"] for r in forward.select(F.explode("ids").alias("id")).groupBy("id").count().collect()}
    weights = np.array([weight(total["docs"], holding[i]) if i in holding else 0 for i in range(len(number))], np.int64)
    searched = []
    for item, terms, times in block:
        ids = np.array([number[t] for t in terms], np.int64)
        searched.append((item, ids, weights[ids] * np.array(times, np.int64)))
    shared = Shared(spark, (searched, len(number), (total["docs"], total["terms"]), k))
    each = forward.mapInArrow(_search(shared), "item bigint, doc_id bigint, score bigint")
    some = _cut(each.withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))), k, "item", "_group").drop("_group", "rank")
    return _cut(some, k, "item")
