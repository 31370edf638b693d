"""Repeated windows of a whole corpus: windows of L symbols whose content starts anywhere else too.

A kind may ask for windows of several lengths, the longest first. Each window start belongs
to the trigger of its shortest window - the position whose rolling hash of ``k`` symbols is
least there - so equal windows of any length have equal triggers. The run of starts with one
trigger, with the symbols their longest windows cover as far as the text goes, is a phrase:

1. Phrases are hashed in one pass. Those whose trigger occurs once in the corpus hold no
   repeat; they are most of the text, and end here.
2. The dictionary holds each distinct remaining phrase with its count. A phrase that
   occurs twice is repeated as a whole, however often it occurs.
3. Where one trigger has several distinct phrases, they are compared window by window, in
   shards of the dictionary, by the caller's structure (automaton or suffix array).
4. A trigger with over ``HOT`` distinct phrases, as beside a line that very many documents
   share, has its phrases cut into parts, each length apart: the starts of a part lie within ``cuts``
   places at a fixed distance from the trigger, and the symbols that all its windows hold (its core)
   are its new trigger. Equal windows lie in parts with equal cores. Parts are phrases again (2 and
   3); where a core is hot too, as it lies in the shared line, its parts are cut more
   finely. A part of one start is its window, so 2 settles it. A document meets each size
   of cut a few times a shared line, not once a window.
5. The repeated windows of each phrase return to the documents that hold it.

Hashes have 64 bits; two different windows are taken for equal with a chance of about
n^2 / 2^65 for n windows that are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .storage import keyed, slices, written

#: Distinct phrases of one trigger compared in one shard; phrases a shard.
HOT, SHARD = 512, 1024
_LOW = np.uint64((1 << 24) - 1)
#: Window starts cut at once.
_PIECE = 1 << 22
_BLOCKS = "array<struct<a:bigint,c:bigint,s:int,m:int>>"
_U64 = (1 << 64) - 1


@dataclass(frozen=True)
class Kind:
    """What a symbol is, and how long windows and triggers are."""

    #: Window lengths, the longest first; what the longest find is removed.
    lengths: tuple[int, ...]
    trigger: int
    #: Window starts of the parts that hot phrases are cut to, from coarse to one.
    cuts: tuple[int, ...]
    #: Text to one 64-bit symbol for each place, and to the places themselves (sliceable).
    symbols: Callable[[bytes], np.ndarray]
    places: Callable[[bytes], list[bytes] | bytes]
    #: A slice of places as bytes.
    packed: Callable[[list[bytes] | bytes], bytes]
    #: Phrases (payload, weight, window starts) to a boolean array of repeated starts for each length.
    compare: Callable[[list[bytes], list[int], list[int], tuple[int, ...]], list[list[np.ndarray]]]

    @property
    def window(self) -> int:
        return self.lengths[0]


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each run of ``width`` hashes, the first of equals."""
    packed = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    return (fp.sliding_minimum(packed, width) & _LOW).astype(np.int64)


def phrases(symbols: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """(trigger hash, phrase hash, first start, number of starts) of each phrase."""
    found, short = [], kind.lengths[-1]
    n = max(0, len(symbols) - short + 1)
    for base in range(0, n, _PIECE):
        part = symbols[base : base + _PIECE + kind.window - 1]
        sums = fp.prefix(part)
        hashes = fp.windows(sums, kind.trigger)
        at = _least(hashes, short - kind.trigger + 1)[: min(_PIECE, n - base)]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        count = np.diff(starts, append=len(at))
        content = fp.ranges(sums, starts, np.minimum(starts + count + kind.window - 1, len(part)))
        content = fp.mix(content + count.astype(np.uint64))
        found.append((hashes[at[starts]].view(np.int64), content.view(np.int64), starts + base, count))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def parts_of(symbols: np.ndarray, kind: Kind, starts: int, k: int, size: int) -> tuple[np.ndarray, ...]:
    """(core hash, part hash, first start, number of starts) of the parts of a phrase for the k-th length, ``size`` starts each at most."""
    length = kind.lengths[k]
    starts = min(starts, len(symbols) - length + 1)
    if starts <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sums = fp.prefix(symbols)
    at = _least(fp.windows(sums[: kind.lengths[-1] + 1], kind.trigger), kind.lengths[-1] - kind.trigger + 1)[0]
    far = (at - np.arange(starts)) // size
    first = np.flatnonzero(np.diff(far, prepend=far[0] + 1))
    count = np.diff(first, append=starts)
    core = at - far[first] * size
    key = fp.mix(fp.ranges(sums, core, core - size + 1 + length) + fp.mix(far[first].astype(np.uint64) * np.uint64(4) + np.uint64(k)))
    content = fp.mix(fp.ranges(sums, first, first + count + length - 1) + count.astype(np.uint64))
    return key.view(np.int64), content.view(np.int64), first, count


def _describe(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sha, parts, ends = [], [], [], [0]
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                text = text or b""
                symbols = kind.symbols(text)
                found = phrases(symbols, kind)
                n.append(len(symbols))
                sha.append(hashlib.sha256(kind.packed(kind.places(text))).hexdigest())
                parts.append(found)
                ends.append(ends[-1] + len(found[0]))
            a, c, s, m = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
            rows = pa.StructArray.from_arrays([pa.array(a), pa.array(c), pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32))], ["a", "c", "s", "m"])
            blocks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), blocks], ["_key", "doc_id", "n", "sha", "blocks"])

    return run


def _payloads(kind: Kind):
    """The symbols of the phrases asked for, out of their first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, payload = [], []
            for text, asked in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places = kind.places(text or b"")
                for x in asked:
                    rows.append(x)
                    payload.append(kind.packed(places[x["s"] : x["s"] + x["m"] + kind.window - 1]))
            columns = [pa.array([x[c] for x in rows], pa.int64()) for c in ("a", "c", "weight", "kinds", "m")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(payload, pa.binary())], ["a", "c", "weight", "kinds", "m", "payload"])

    return run


def _parts(kind: Kind, size: int):
    """Phrases (a, c, weight, m, k or null for all lengths, payload) cut to parts: (whole_a, whole_c, offset) and the part's own (a, c, m, k, weight, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, made, payload = [], [], []
            for row, (trigger, starts, which, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True)):
                symbols, places = kind.symbols(text), kind.places(text)
                for k in range(len(kind.lengths)) if which is None else (which,):
                    a, c, s, m = parts_of(symbols, kind, starts, k, size)
                    a = fp.mix(a.view(np.uint64) ^ np.uint64(trigger & _U64)).view(np.int64)
                    of += [row] * len(a)
                    made += zip(s.tolist(), a.tolist(), c.tolist(), m.tolist(), [k] * len(a), strict=True)
                    payload += [kind.packed(places[i : i + n + kind.lengths[k] - 1]) for i, n in zip(s.tolist(), m.tolist(), strict=True)]
            at = pa.array(of, pa.int64())
            columns = [pa.array([x[i] for x in made], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
            names = ["whole_a", "whole_c", "offset", "a", "c", "m", "k", "weight", "payload"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns, batch.column(2).take(at), pa.array(payload, pa.binary())], names)

    return run


#: Runs [lo, hi) of window starts of the k-th length.
_SPANS = "array<struct<lo:int,hi:int,k:int>>"
_SPAN = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("k", pa.int32())])


def runs(mask: np.ndarray, k: int = 0) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return [{"lo": int(lo), "hi": int(hi), "k": k} for lo, hi in zip(edge[::2], edge[1::2], strict=True)]


def _compared(kind: Kind):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        weight, which = table["weight"].to_pylist(), key[0].as_py()
        lengths = kind.lengths if which is None else (kind.lengths[which],)
        masks = kind.compare(table["payload"].to_pylist(), weight, table["m"].to_pylist(), lengths)
        spans = [[x for k, mask in enumerate(found) for x in runs(mask, which or k)] if w == 1 else [] for w, found in zip(weight, masks, strict=True)]
        some = [i for i, x in enumerate(spans) if x]
        where = pa.array(some, pa.int64())
        return pa.table({"a": table["a"].take(where), "c": table["c"].take(where), "spans": pa.array([spans[i] for i in some], pa.list_(_SPAN))})

    return run


def _whole(dictionary: DataFrame, lengths: int) -> DataFrame:
    """Phrases that occur twice are repeated from their first to their last start; ``_covered`` leaves out windows that the text does not hold."""
    every = F.array(*[F.lit(k) for k in range(lengths)])
    of = F.when(F.col("k").isNull(), every).otherwise(F.array("k"))
    spans = F.transform(of, lambda k: F.struct(F.lit(0).alias("lo"), F.col("m").cast("int").alias("hi"), k.alias("k")))
    return dictionary.filter("n >= 2").select("a", "c", spans.alias("spans"))


def _resolve(payloads: DataFrame, kind: Kind, level: int = 0) -> DataFrame:
    """(a, c, spans) of the repeated windows of phrases (a, c, weight, kinds, m, k, payload) that occur once; kinds >= 2."""
    shards = max(1, payloads.filter(F.col("kinds") <= HOT).count() // SHARD)
    cold = payloads.filter(F.col("kinds") <= HOT).withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))
    found = cold.groupBy("k", "shard").applyInArrow(_compared(kind), f"a bigint, c bigint, spans {_SPANS}")
    hot = payloads.filter(F.col("kinds") > HOT)
    # the parts of the last cut are windows: equal or of different cores, so none is left here
    if level == len(kind.cuts) or not hot.limit(1).count():
        return found
    parts = hot.select("a", "c", "weight", "m", "k", "payload").mapInArrow(_parts(kind, kind.cuts[level]), "whole_a bigint, whole_c bigint, offset int, a bigint, c bigint, m bigint, k int, weight bigint, payload binary")
    parts = written(parts, "parts")
    dictionary = written(parts.groupBy("a", "c").agg(F.sum("weight").alias("n"), F.min("m").alias("m"), F.min("k").alias("k"), F.first("payload").alias("payload")), "part_dictionary")
    kinds = written(dictionary.groupBy("a").agg(F.count("*").alias("kinds")).filter("kinds >= 2"), "part_kinds")
    again = dictionary.join(kinds, "a").select("a", "c", F.least("n", F.lit(2)).cast("bigint").alias("weight"), "kinds", "m", "k", "payload")
    status = written(_whole(dictionary, len(kind.lengths)).unionByName(_resolve(written(again, "part_payloads"), kind, level + 1)), "part_repeated")
    moved = F.transform("spans", lambda x: F.struct((x["lo"] + F.col("offset")).alias("lo"), (x["hi"] + F.col("offset")).alias("hi"), x["k"].alias("k")))
    back = parts.filter("weight = 1").select("whole_a", "whole_c", "offset", "a", "c").join(status, ["a", "c"]).select("whole_a", "whole_c", moved.alias("spans"))
    back = back.groupBy(F.col("whole_a").alias("a"), F.col("whole_c").alias("c")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return found.unionByName(back)


def _covered(lo: np.ndarray, hi: np.ndarray, length: int, n: int) -> list[dict[str, int]]:
    """The symbols of n under windows of ``length`` that start in the runs [lo, hi), as runs."""
    step = np.zeros(n + 1, np.int64)
    hi = np.minimum(hi, n - length + 1)
    some = lo < hi
    np.add.at(step, lo[some], 1)
    np.add.at(step, hi[some] + length - 1, -1)
    return runs(np.cumsum(step)[:-1] > 0)


def _cut(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, counts, kept = [], [[] for _ in kind.lengths], []
            ends, every = batch.column(2).offsets.to_numpy(), batch.column(2).values
            lo, hi, which = (every.field(i).to_numpy().astype(np.int64) for i in range(3))
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                places = kind.places(text or b"")
                own = slice(ends[row], ends[row + 1])
                for k, length in reversed([*enumerate(kind.lengths)]):
                    mine = which[own] == k
                    covered = _covered(lo[own][mine], hi[own][mine], length, len(places))
                    counts[k].append(sum(x["hi"] - x["lo"] for x in covered))
                spans.append(covered)
                left, at = [], 0
                for x in [*covered, {"lo": len(places), "hi": len(places)}]:
                    left.append(places[at : x["lo"]])
                    at = x["hi"]
                joined = b"".join(left) if isinstance(places, bytes) else [w for part in left for w in part]
                kept.append(kind.packed(joined))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            repeated = pa.array([list(x) for x in zip(*counts, strict=True)], pa.list_(pa.int64()))
            made = [repeated, pa.array(spans, pa.list_(_SPAN)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["_key", "repeated", "ranges", "cut_sha", "kept"])

    return run


def remove_repeats(docs: DataFrame, kind: Kind, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """A row for each document: ``_key, doc_id, n, n_removed, repeated (symbols under repeated windows of each length), ranges (removed symbols), kept_sha256`` and, if asked for, ``kept``."""
    rows, _ = keyed(docs, doc_id, text)
    rows = rows.withColumnRenamed(text, "text")
    id_type = dict(rows.dtypes)["doc_id"]
    described = written(rows.mapInArrow(_describe(kind), f"_key bigint, doc_id {id_type}, n bigint, sha string, blocks {_BLOCKS}"), "phrases")
    block = described.select("_key", F.inline("blocks"))
    # the counts are written, so that the joins below meet two plain shuffles, which can be split where a trigger is hot
    twice = written(block.groupBy("a").count().filter("count >= 2").select("a"), "triggers")
    shared = written(block.join(twice, "a", "left_semi"), "shared")
    dictionary = written(shared.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("_key", "s")).alias("at"), F.min("m").alias("m")).withColumn("k", F.lit(None).cast("int")), "dictionary")
    kinds = written(dictionary.groupBy("a").agg(F.count("*").alias("kinds")).filter("kinds >= 2"), "kinds")
    weight = F.least("n", F.lit(2)).cast("bigint")
    one = F.struct("a", "c", weight.alias("weight"), "kinds", F.col("at.s").alias("s"), "m")
    asked = dictionary.join(kinds, "a").select(F.col("at._key").alias("_key"), one.alias("x")).groupBy("_key").agg(F.collect_list("x").alias("asked"))
    payloads = rows.select("_key", "text").join(asked, "_key").select("text", "asked").mapInArrow(_payloads(kind), "a bigint, c bigint, weight bigint, kinds bigint, m bigint, payload binary").withColumn("k", F.lit(None).cast("int"))
    status = written(_whole(dictionary, len(kind.lengths)).unionByName(_resolve(written(payloads, "payloads"), kind)), "repeated")
    spans = shared.join(status, ["a", "c"]).select("_key", "s", F.explode("spans").alias("x"))
    spans = spans.groupBy("_key").agg(F.collect_list(F.struct((F.col("s") + F.col("x.lo")).alias("lo"), (F.col("s") + F.col("x.hi")).alias("hi"), F.col("x.k").alias("k"))).alias("spans"))
    cut = rows.select("_key", "text").join(spans, "_key").mapInArrow(_cut(kind), f"_key bigint, repeated array<bigint>, ranges {_SPANS}, cut_sha string, kept binary")
    if not keep_text:
        cut = cut.drop("kept")
    none = F.array(*[F.lit(0).cast("long") for _ in kind.lengths])
    out = described.drop("blocks").join(cut, "_key", "left").withColumn("repeated", F.coalesce("repeated", none))
    ranges = F.transform(F.coalesce("ranges", F.array().cast(_SPANS)), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))
    out = out.withColumns({"n_removed": F.get("repeated", F.lit(0)), "ranges": ranges, "kept_sha256": F.coalesce("cut_sha", "sha")})
    return out.select("_key", "doc_id", "n", "n_removed", "repeated", "ranges", "kept_sha256", *(["kept"] if keep_text else []))
