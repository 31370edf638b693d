"""Near-duplicate documents by a MinHash LSH forest, links confirmed on whole shingle sets.

1. A document's set is hashed once; documents with equal sets form a class, and only the
   class's first member goes on. A class of a third of all rows costs one row a task.
2. Each representative enters sorted orders (``orders_for`` the threshold) of its signature (each begins at
   another coordinate). An order is range-partitioned and sorted, so a hot prefix spreads
   over tasks. Neighbours in an order that share the first ``DEPTH`` coordinates are
   candidates: all pairs in a region of up to ``REACH`` + 1, the ``NEAR`` nearest - those with
   the longest common prefix - where a region is denser. Pairs whose signatures differ too
   much for the threshold go at once. Members of a denser region are tied to one family whatever
   their neighbours; the ends of a region that runs on over partitions are compared in one more step.
3. Candidates are confirmed on whole sets, in cells of bounded size.
4. What a dense region's limit may have left out is settled exactly: candidates fall into
   families (components of candidates and ties); every member outside the largest
   confirmed component of its family is compared with every member of other components.

Defined results: null, empty and wordless texts have an empty set, no link and stay;
a text of fewer than five words has one shingle, its words; repeated rows form a class;
with null or repeated ids the component's name is the smallest non-null id in it. An empty table gives
no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .components import components
from .storage import keyed, slices, written

WORDS, PERCENT = 5, 85
#: Coordinates all candidates share, coordinates an order is sorted by, the most orders.
DEPTH, SORTED, MOST = 4, 12, 64
#: Two documents at the threshold share no prefix in this share of pairs at most.
MISSED = 8e-6
REACH, NEAR = 16, 4
#: Documents of one family that are compared in one task.
BLOCK = 1024
_MULTIPLIERS = np.random.default_rng(10).integers(0, 2**63, MOST * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Where the set's similarity is the threshold, equal coordinates fall this many deviations short about once in a million.
_DEVIATIONS = 5.5


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    return fp.shingles(fp.word_symbols(text.lower()), words) if text else np.zeros(0, np.uint64)


def orders_for(percent: int) -> int:
    """As many orders as the threshold needs: 16 for 85, 23 for 80; raises where that is more than ``MOST`` (under 64 percent)."""
    share = (percent / 100) ** DEPTH
    orders = 1 if share >= 1 else int(np.ceil(np.log(MISSED) / np.log(1 - share))) if share > 0 else MOST + 1
    if orders > MOST:
        raise ValueError(f"{percent} percent needs more than {MOST} orders of {DEPTH} coordinates")
    return orders


def least_equal(percent: int) -> int:
    """Equal coordinates that a pair at the threshold has, but for once in a million."""
    n, share = orders_for(percent) * DEPTH, percent / 100
    return int(n * share - _DEVIATIONS * (n * share * (1 - share)) ** 0.5)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The least hash for each multiplier: its low 16 bits."""
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        some = shingles[at : at + 1024, None] * _MULTIPLIERS[:coordinates]
        least = np.minimum(least, (some >> np.uint64(20)).min(axis=0))
    return (least & np.uint64(0xFFFF)).astype(">u2")


def _describe(words: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, one, two, signs = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                one.append(int(fp.prefix(s)[-1].astype(np.int64)))
                two.append(int(fp.mix(s).sum(dtype=np.uint64).astype(np.int64)))
                signs.append(signature(s, coordinates).tobytes() if len(s) else None)
            made = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["_key", "doc_id", "n", "h1", "h2", "sign"])

    return run


def _orders(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(place, node, brief): the signature from each order's first coordinate on, after the order's number."""
        for batch in slices(batches, 4096):
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, trees * DEPTH)
            brief = pa.array([x.tobytes() for x in (signs & 0xFF).astype(np.uint8)], pa.binary())
            for tree in range(trees):
                turned = np.take(signs, np.arange(tree * DEPTH, tree * DEPTH + SORTED) % (trees * DEPTH), axis=1)
                place = pa.array([bytes([tree]) + x.tobytes() for x in turned], pa.binary())
                yield pa.RecordBatch.from_arrays([place, batch.column(0), brief], ["place", "node", "brief"])

    return run


_HEAD = 1 + 2 * DEPTH
_FOUND = "a bigint, b bigint, tie boolean, place binary, brief binary, dense boolean"


def _pairs(left: np.ndarray, right: np.ndarray, tie: bool) -> pa.RecordBatch:
    n = len(left)
    rest = [pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right), pa.int64()), pa.array(np.maximum(left, right), pa.int64()), pa.array([tie] * n, pa.bool_()), *rest], ["a", "b", "tie", "place", "brief", "dense"])


def _neighbours(least: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidate pairs, ties between members of a dense region, and (with no b) the rows of the regions at the partition's ends."""
        hold = REACH + 1
        spot = np.zeros((0, 1 + 2 * SORTED), np.uint8)
        node, brief, depth = np.zeros(0, np.int64), np.zeros((0, coordinates), np.uint8), np.zeros(0, np.int64)
        first: list[tuple[np.ndarray, int, np.ndarray]] = []
        first_size, first_open = 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(node)
            spot = np.concatenate([spot, np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 1 + 2 * SORTED)])
            region = spot[:, :_HEAD]
            node = np.concatenate([node, batch.column(1).to_numpy()])
            brief = np.concatenate([brief, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, coordinates)])
            # place of each row in its region, counted on from the rows carried over
            same = np.concatenate([[False], (region[1:] == region[:-1]).all(axis=1)])
            starts = np.where(same, 0, np.arange(len(node)))
            place = np.arange(len(node)) - np.maximum.accumulate(starts)
            if old:
                run_on = np.flatnonzero(~same[old:])
                end = old + (run_on[0] if len(run_on) else len(node) - old)
                place[old:end] = depth[-1] + 1 + np.arange(end - old)
                place[:old] = depth
            if first_open:
                begins = np.flatnonzero(place[old:] == 0)
                stop = len(node) if len(begins) <= (not old) else old + begins[0 if old else 1]
                first += [(spot[k], int(node[k]), brief[k]) for k in range(old, min(stop, old + hold - len(first)))]
                first_size, first_open = first_size + stop - old, stop == len(node)
            left, right = [], []
            for lag in range(1, REACH + 1):
                i = np.arange(max(old, lag), len(node))
                i = i[(place[i] >= lag) & ((place[i] <= REACH) | (lag <= NEAR))]
                i = i[(brief[i] == brief[i - lag]).sum(axis=1) >= least]
                left.append(node[i - lag])
                right.append(node[i])
            yield _pairs(np.concatenate(left), np.concatenate(right), False)
            # a region with more members than are all compared is one family, whatever its neighbours
            dense = np.arange(old, len(node))[place[old:] > REACH]
            begun = dense[place[dense] == hold]
            back = [(k - lag, k) for k in begun for lag in range(2, hold + 1)]
            yield _pairs(node[np.concatenate([dense - 1, [x for x, _ in back]]).astype(np.int64)], node[np.concatenate([dense, [x for _, x in back]]).astype(np.int64)], True)
            spot, node, brief, depth = spot[-hold:], node[-hold:], brief[-hold:], place[-hold:]
        if not len(node):
            return
        ends = {n: (p, b, first_size > hold) for p, n, b in first}
        for k in np.flatnonzero((spot[:, :_HEAD] == spot[-1, :_HEAD]).all(axis=1)):
            ends[int(node[k])] = (spot[k], brief[k], bool(depth[-1] >= hold))
        made = [pa.array(list(ends), pa.int64()), pa.nulls(len(ends), pa.int64()), pa.nulls(len(ends), pa.bool_())]
        made += [pa.array([x[0].tobytes() for x in ends.values()], pa.binary()), pa.array([x[1].tobytes() for x in ends.values()], pa.binary()), pa.array([x[2] for x in ends.values()], pa.bool_())]
        yield pa.RecordBatch.from_arrays(made, ["a", "b", "tie", "place", "brief", "dense"])

    return run


def _across(least: int, coordinates: int):
    def run(table: pa.Table) -> pa.Table:
        """The same for the ends of one region in several partitions: all pairs, or neighbours and ties where a part is dense."""
        table = table.sort_by([("place", "ascending"), ("a", "ascending")])
        node = table["a"].to_numpy()
        brief = np.frombuffer(b"".join(table["brief"].to_pylist()), np.uint8).reshape(-1, coordinates)
        dense = any(table["dense"].to_pylist()) or len(node) > 4 * (REACH + 1)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, min(len(node), 4 * (REACH + 1) if not dense else REACH + 1)):
            i = np.flatnonzero((brief[lag:] == brief[:-lag]).sum(axis=1) >= least)
            left.append(node[i])
            right.append(node[i + lag])
        made = [_pairs(np.concatenate(left), np.concatenate(right), False)]
        if dense:
            made.append(_pairs(node[:-1], node[1:], True))
        return pa.Table.from_batches(made).select(["a", "b", "tie"])

    return run


def candidates(signs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``signs(node, sign)`` to distinct ``(a, b, tie)``, a < b: pairs to be confirmed, and ties that only say that two are of one family."""
    least, trees = least_equal(percent), orders_for(percent)
    orders = signs.select("node", "sign").mapInArrow(_orders(trees), "place binary, node bigint, brief binary")
    parts = int(signs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = orders.repartitionByRange(parts, "place", "node").sortWithinPartitions("place", "node")
    found = written(ranged.mapInArrow(_neighbours(least, trees * DEPTH), _FOUND), "neighbours")
    ends = found.filter("b is null").select("a", "place", "brief", "dense").groupBy(F.substring("place", 1, _HEAD))
    across = ends.applyInArrow(_across(least, trees * DEPTH), "a bigint, b bigint, tie boolean")
    return found.filter("b is not null").select("a", "b", "tie").unionByName(across).distinct()


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, words).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "items"])

    return run


class _Cell:
    """The sets of a cell, and intersections of one set with many."""

    def __init__(self, table: pa.Table):
        self.sets = {k: np.frombuffer(v, np.uint64) for k, v in zip(table["node"].to_pylist(), table["items"].to_pylist(), strict=True)}

    def similar(self, a: int, others: list[int], percent: int) -> list[int]:
        x = self.sets[a]
        others = [b for b in others if 100 * min(len(x), len(self.sets[b])) >= percent * max(len(x), len(self.sets[b]))]
        out = []
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            parts = [self.sets[b] for b in some]
            sizes = np.array([len(p) for p in parts])
            y = np.concatenate(parts)
            found = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
            both = np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            out += [b for b, ok in zip(some, 100 * both >= percent * (len(x) + sizes - both), strict=True) if ok]
        return out


_LINKS = "a bigint, b bigint"


def _linked(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _confirm(percent: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        cell, left, right = _Cell(sets), [], []
        by: dict[int, list[int]] = {}
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            by.setdefault(a, []).append(b)
        for a, others in by.items():
            good = cell.similar(a, others, percent)
            left += [a] * len(good)
            right += good
        return _linked(left, right)

    return run


def _settle(percent: int):
    least, coordinates = least_equal(percent), orders_for(percent) * DEPTH

    def run(members: pa.Table) -> pa.Table:
        """One link at most for each member outside and component it reaches."""
        cell, left, right = _Cell(members), [], []
        rows = list(zip(members["node"].to_pylist(), members["component"].to_pylist(), members["outside"].to_pylist(), strict=True))
        brief = {k: (signature(x, coordinates) & 0xFF).astype(np.uint8) for k, x in cell.sets.items()}
        inner = [(node, component) for node, component, outside in rows if not outside]
        briefs = np.array([brief[node] for node, _ in inner], np.uint8).reshape(-1, coordinates)
        for node, component, outside in rows:
            groups: dict[int, list[int]] = {}
            for k in np.flatnonzero((briefs == brief[node]).sum(axis=1) >= least) if outside else ():
                if inner[k][1] != component:
                    groups.setdefault(inner[k][1], []).append(inner[k][0])
            for others in groups.values():
                for at in range(0, len(others), 64):
                    if good := cell.similar(node, others[at : at + 64], percent):
                        left.append(node)
                        right.append(good[0])
                        break
        return _linked(left, right)

    return run


def links(docs: DataFrame, pairs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs(node, text)`` and candidates ``(a, b, tie)`` to links that leave the components of all links within families whole."""
    families = written(components(pairs.select("a", "b")), "families")
    pairs = pairs.filter("not tie").select("a", "b")
    sized = families.join(families.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")), "component")
    placed = sized.select("node", F.col("component").alias("family"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    placed = written(placed, "placed")
    texts = docs.join(placed, "node", "left_semi").select("node", "text")
    sets = written(texts.mapInArrow(_sets(words), "node bigint, items binary"), "sets")

    left = placed.select(F.col("node").alias("a"), "family", F.col("block").alias("i"))
    right = placed.select(F.col("node").alias("b"), F.col("block").alias("j"))
    dealt = written(pairs.join(left, "a").join(right, "b").select("a", "b", "family", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")), "dealt")
    cell = ["family", "i", "j"]
    needed = dealt.select(F.col("a").alias("node"), *cell).unionByName(dealt.select(F.col("b").alias("node"), *cell)).distinct()
    held = written(needed, "needed").join(sets, "node")
    first = written(dealt.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(_confirm(percent), _LINKS), "confirmed")

    joined = families.withColumnRenamed("component", "family").join(components(first), "node", "left")
    joined = written(joined.withColumn("component", F.coalesce("component", "node")), "joined")
    sizes = joined.groupBy("family", "component").count()
    largest = sizes.groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("parts"))
    split = joined.join(largest.filter("parts > 1"), "family").join(placed.select("node", "block"), "node")
    split = written(split.select("node", "family", "component", "block", (F.col("component") != F.col("largest")).alias("outside")), "split")
    outer = split.filter("outside")
    blocks = outer.groupBy("family").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("outers"))
    # cell (family, part of the outsiders, block): those outsiders beside that block's members
    outer = outer.join(blocks, "family").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("outers")))
    every = split.select("family", "block").distinct()
    asked = outer.select("node", "family", "component", "part").join(every, "family").select("node", "family", "component", "part", "block", F.lit(True).alias("outside"))
    given = split.join(blocks, "family").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outers") - 1)))
    given = given.select("node", "family", "component", "part", "block", F.lit(False).alias("outside"))
    rest = asked.unionByName(given).join(sets, "node").groupBy("family", "part", "block").applyInArrow(_settle(percent), _LINKS)
    return first.unionByName(written(rest, "settled"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: ``_key, doc_id, n_shingles, component_id, kept``; kept is true once a component."""
    rows, by_id = keyed(docs, doc_id, text)
    rows = rows.withColumnRenamed(text, "text")
    described = written(rows.mapInArrow(_describe(words, orders_for(percent) * DEPTH), f"_key bigint, doc_id {dict(rows.dtypes)['doc_id']}, n bigint, h1 bigint, h2 bigint, sign binary"), "described")
    classes = written(described.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("_key").alias("rep")), "classes")
    signs = described.select(F.col("_key").alias("node"), "sign").join(classes.select(F.col("rep").alias("node")), "node", "left_semi")
    pairs = written(candidates(signs, percent), "pairs")
    found = components(links(rows.select(F.col("_key").alias("node"), "text"), pairs, words, percent))
    member = described.drop("sign").join(classes, ["h1", "h2", "n"], "left")
    member = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep", "_key"))
    if by_id:
        named = member.select("_key", "doc_id", F.col("n").alias("n_shingles"), F.col("component").cast(dict(rows.dtypes)["doc_id"]).alias("component_id"))
        return named.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    names = member.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("first"))
    return member.join(names, "component").select("_key", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("_key") == F.col("first")).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all columns, one document of each component: the one with the smallest id."""
    # numbered columns, as the names of others may be those used here
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows, _ = keyed(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), names[doc_id], *[n for c, n in names.items() if c != doc_id])
    kept = near_duplicates(rows.select("_key", names[text]), "_key", names[text], words, percent).filter("kept").select("_key")
    return rows.join(kept, "_key", "left_semi").select(*[F.col("doc_id" if c == doc_id else n).alias(c) for c, n in names.items()])
