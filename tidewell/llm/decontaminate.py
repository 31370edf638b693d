"""Benchmark decontamination with a generalised suffix automaton over item words.

Words are the maximal runs of ASCII letters, digits and non-ASCII characters of the
text with A-Z lower-cased. The items are cut into blocks of at most
``block_words`` words (long items into pieces that overlap by a window less one
word), so what is broadcast has a fixed bound; a benchmark of several blocks streams
the documents once a block and merges the spans. For one block no row is shuffled.

Defined results: a null or wordless text has no words and no hits; items with a null
id or text, or without words, are ignored; repeated items and documents count as they
stand; an empty benchmark leaves every document clean. Only the named columns are
read, so extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import WordAutomaton
from .storage import Shared, slices, written

WINDOW = 10
BLOCK_WORDS = 100_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FOUND = "n_words bigint, longest bigint, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class ItemAutomaton(WordAutomaton):
    """Generalised suffix automaton of word sequences; states also know the items whose window ends there."""

    def __init__(self, items: Iterable[tuple[str, list[bytes], bool]], window: int = WINDOW):
        """items: (id, words, whole); pieces of a longer item are not whole and never count as short items."""
        super().__init__()
        self.window = window
        items = [x for x in items if x[1]]
        ends: dict[int, set[tuple[int, str]]] = {}
        for name, words, whole in items:
            last = 0
            for word in words:
                last = self.extend(last, word)
            if whole and len(words) < window:
                ends.setdefault(last, set()).add((len(words), name))
        n = len(self.next)
        order = self.by_length()
        #: The suffix of each state's strings that is one window long, as a state.
        self.base = list(range(n))
        #: (length, item) of the short items that end in each state's strings, shortest first.
        self.short: list[tuple[tuple[int, str], ...]] = [()] * n
        for v in order:
            up = self.link[v]
            if self.length[up] >= window:
                self.base[v] = self.base[up]
            self.short[v] = self.short[up] + tuple(sorted(ends[v])) if v in ends else self.short[up]
        found: dict[int, set[str]] = {}
        for name, words, _ in items:
            v = 0
            for i, word in enumerate(words):
                v = self.next[v][word]
                if i + 1 >= window:
                    found.setdefault(self.base[v], set()).add(name)
        self.items = {v: tuple(sorted(names)) for v, names in found.items()}
        self.least = min([window, *(k for e in ends.values() for k, _ in e)])

    def match(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(longest match, merged hit spans, items): one step of the automaton a word."""
        nxt, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        v = at = longest = 0
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for i, word in enumerate(words):
            t = nxt[v].get(word)
            while t is None and v:
                v = link[v]
                at = length[v]
                t = nxt[v].get(word)
            if t is None:
                at = 0
                continue
            v = t
            at += 1
            if at > longest:
                longest = at
            if at < least:
                continue
            reach = 0
            if at >= window:
                reach = window
                items.update(self.items[self.base[v]])
            for k, name in self.short[v]:
                if k > at:
                    break
                reach = max(reach, k)
                items.add(name)
            if reach:
                start = i + 1 - reach
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return longest, spans, items


def _pieces(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"item": [], "words": [], "n": [], "whole": []}
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = words_of(text)
            for at in range(0, max(1, len(words) - window + 1) if words else 0, most):
                part = words[at : at + most + window - 1]
                for name, x in (("item", item), ("words", b" ".join(part)), ("n", len(part)), ("whole", len(words) < window)):
                    out[name].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.string()), pa.array(out["words"], pa.binary()), pa.array(out["n"], pa.int64()), pa.array(out["whole"], pa.bool_())], list(out))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes], bool]]]:
    """The item pieces, at most ``2 * block_words`` words (in expectation half) at a time."""
    items = benchmark.select(F.col(item_id).cast("string"), F.col(text)).dropna()
    most = max(1, block_words // 4)
    # written, so that items are cut into words once, not once a block
    pieces = written(items.mapInArrow(lambda x: _pieces(x, window, most), "item string, words binary, n bigint, whole boolean"), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // block_words))
    placed = pieces.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(parts)))
    for part in range(parts):
        block: list[tuple[str, list[bytes], bool]] = []
        held = 0
        for row in placed.filter(F.col("part") == part).toLocalIterator():
            block.append((row["item"], bytes(row["words"]).split(), row["whole"]))
            held += row["n"]
            if held >= 2 * block_words - most:
                yield block
                block, held = [], 0
        yield block


_built: dict = {}


def _automaton(shared: Shared) -> ItemAutomaton:
    """The broadcast block's automaton, built once in each Python worker."""
    if shared.id not in _built:
        _built.clear()
        window, items = shared.value
        _built[shared.id] = ItemAutomaton(items, window)
    return _built[shared.id]


def _scan(shared: Shared, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared)
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            n, longest, spans, items = [], [], [], []
            for text in batch.column(kept).cast(pa.binary()).to_pylist():
                words = words_of(text)
                far, where, which = automaton.match(words)
                n.append(len(words))
                longest.append(far)
                spans.append([{"start": s, "end": e} for s, e in where])
                items.append(sorted(which))
            found = [pa.array(n, pa.int64()), pa.array(longest, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), *found], [*batch.schema.names[:kept], "n_words", "longest", "spans", "items"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep`` columns with n_words, longest (match, in words), spans (hit words, merged, end exclusive) and items."""
    spark = docs.sparkSession
    each = blocks(benchmark, window=window, block_words=block_words)
    some = [next(each), *([second] if (second := next(each, None)) is not None else [])]
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(_FOUND).fields])
    if len(some) == 1:
        return source.mapInArrow(_scan(Shared(spark, (window, some[0])), len(keep)), schema)
    numbered = written(source.withColumn("_row", F.monotonically_increasing_id()), "documents").select("_row", *keep, "_text")
    one = T.StructType([T.StructField("_row", T.LongType()), *schema.fields])
    found = None
    for block in chain(some, each):
        shared = Shared(spark, (window, block))
        # written, so that a block's broadcast is released before the next
        part = written(numbered.mapInArrow(_scan(shared, len(keep) + 1), one), "spans")
        shared.broadcast.unpersist()
        found = part if found is None else found.unionByName(part)
    first = [F.first(c).alias(c) for c in (*keep, "n_words")]
    merged = found.groupBy("_row").agg(*first, F.max("longest").alias("longest"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.withColumn("spans", _merge(F.array_sort("spans"))).select(*keep, "n_words", "longest", "spans", "items")


def _merge(spans):
    """Sorted spans of several blocks with overlaps joined."""
    one = "array<struct<start:int,end:int>>"

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast(one), add)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and what lies between them."""
    folded = text.translate(_FOLD)
    words, at, where = folded.split(), 0, []
    for word in words:
        at = folded.index(word, at)
        where.append(at)
        at += len(word)
    kept, last = [], 0
    for s, e in spans:
        kept.append(text[last : where[s]])
        last = where[e - 1] + len(words[e - 1])
    return b"".join([*kept, text[last:]])


def _cut(text: bytes, automaton: ItemAutomaton, max_share: float) -> bytes | None:
    """``text`` without hit words, until none is left; None where more than ``max_share`` of the words go."""
    total = None
    gone = 0
    while True:
        words = words_of(text)
        total = len(words) if total is None else total
        _, spans, _ = automaton.match(words)
        if not spans:
            return text
        gone += sum(e - s for s, e in spans)
        if gone > max_share * total:
            return None
        text = _without(text, spans)


def _cut_found(at: int, n: int, max_share: float):
    """Rows of n columns, then (row, total, gone, n_words, spans), to the same without n_words and spans, each text cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, totals, gones, stay = [], [], [], []
            counts = [batch.column(n + k).to_pylist() for k in range(1, 5)]
            for text, total, gone, words, found in zip(batch.column(at).cast(pa.binary()).to_pylist(), *counts, strict=True):
                spans = [(x["start"], x["end"]) for x in found]
                totals.append(words if total is None else total)
                gones.append(gone + sum(e - s for s, e in spans))
                stay.append(gones[-1] <= max_share * totals[-1])
                texts.append(_without(text, spans))
            column = pa.array(texts, pa.binary()).cast(pa.string()).cast(batch.column(at).type)
            columns = [column if i == at else batch.column(i) for i in range(n + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(gones, pa.int64())], batch.schema.names[: n + 3]).filter(pa.array(stay, pa.bool_()))

    return run


def _cut_by_blocks(docs: DataFrame, benchmark: DataFrame, at: int, window: int, max_share: float, block_words: int) -> DataFrame:
    """As one automaton of all items would: each pass takes the spans of all blocks together, and goes on with the texts it has cut."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.monotonically_increasing_id().alias("_place"))
    left = written(rows.withColumns({"_total": F.lit(None).cast("long"), "_gone": F.lit(0).cast("long")}), "left")
    schema, done = left.schema, None
    while True:
        found = matches(left, benchmark, ("_place",), names[at], window, block_words).filter(F.size("spans") > 0).select("_place", "n_words", "spans")
        joined = written(left.join(found, "_place", "left").select(*schema.names, "n_words", "spans"), "joined")
        clean = joined.filter("spans is null").select(*names)
        done = clean if done is None else done.unionByName(clean)
        left = written(joined.filter("spans is not null").mapInArrow(_cut_found(at, len(names), max_share), schema), "left")
        if left.isEmpty():
            return done.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str | None = None, window: int = WINDOW, max_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with benchmark spans cut from ``text``; a document that would lose over ``max_share`` of its words goes.

    All columns stay as they are but ``text`` and, where named, ``n_chars``. Cutting is
    repeated until no window of any block is left, as the words beside a cut meet.
    """
    at = docs.columns.index(text)
    each = blocks(benchmark, window=window, block_words=block_words)
    block = next(each)
    if next(each, None) is not None:
        out = _cut_by_blocks(docs, benchmark, at, window, max_share, block_words)
    else:
        shared = Shared(docs.sparkSession, (window, block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared)
            for batch in slices(batches):
                column = batch.column(at)
                texts = column.cast(pa.binary()).to_pylist()
                cut = [t if t is None else _cut(t, automaton, max_share) for t in texts]
                stay = pa.array([a is None or b is not None for a, b in zip(texts, cut, strict=True)])
                new = pa.array(cut, pa.binary()).cast(pa.string()).cast(column.type)
                yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names).filter(stay)

        out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars else out
