"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, exact rerank.

Equal vectors form a class first, so a vector with a third of all rows costs one row a
task. Each class sits in the inverted list of its nearest coarse centroid, with its residual
as one code for each of ``PARTS`` subspaces; lists are packed into bins of ``BLOCK`` classes (a larger
list is dealt out over several):

1. Probes: a class visits every bin that may hold a vector within the threshold, by two bounds
   that no such vector can break: the centroid's distance less the list's largest radius, and
   the distance from the border between the list and its own.
2. In a cell, the distances from a class's own vector to the other side's codes are added up from
   tables (a row of products for each subspace). A code's error is stored, so the
   distance less this error bounds the true one from below, and what it leaves out is no link.
3. What is left is reranked by exact cosines in double precision, once for both ends. What leaves
   a cell is a count for each class and a spanning forest of its links, never the pairs.

Centroids and codes are fitted on at most ``SAMPLE`` classes, chosen by a hash of the vector; they
decide how much is compared, never which links are found: recall is 1. Where vectors form no
groups, the probes leave out little, and codes of all pairs of bins are read. Lengths with under
``FEW`` classes have nothing to fit codes on; their vectors are compared as they are.

Defined results: null, empty and zero vectors, and vectors with null or non-finite
components have no links; vectors of different lengths are never linked, those of each length are compared;
repeated rows are linked with each other; with null or repeated ids a component is named
by the smallest non-null id in it. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, join
from .storage import Shared, keyed, slices, written

COSINE = 0.9
SAMPLE, LISTS = 16384, 4096
#: Subspaces of a residual, and codes of each.
PARTS, CODES = 8, 256
#: Classes of a bin; classes that an index needs.
BLOCK, FEW = 4096, 256
#: More than the rounding of a bound, and of distances added up in single precision.
_ROUNDING, _SINGLE = 1e-6, 2e-5


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _means(x: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    """Lloyd's k-means from distinct rows; a centre without rows stays."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Coarse centroids, code books of residuals, and once ``fill`` has seen the lists the bins they are in."""

    def __init__(self, sample: np.ndarray, lists: int):
        x = _unit(sample)
        self.coarse = _means(x, min(lists, len(x)), 8, 1)
        rest = x - self.coarse[self.squares(x).argmin(1)]
        self.parts_of = np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1]))
        self.books = [_means(rest[:, part], min(CODES, len(x)), 8, 2) for part in self.parts_of]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, the part of a squared distance that does not depend on the other vector, error) of rows in lists ``own``."""
        base = self.coarse[own]
        rest, near = x - base, np.zeros_like(x)
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        for m, (part, book) in enumerate(zip(self.parts_of, self.books, strict=True)):
            codes[:, m] = ((book * book).sum(1) - 2 * rest[:, part] @ book.T).argmin(1)
            near[:, part] = book[codes[:, m]]
        return codes, (near * near).sum(1) + 2 * (base * near).sum(1), np.sqrt(((rest - near) ** 2).sum(1))

    def distances(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Squared distances to each row of ``x`` (a column) from the vectors that codes in lists ``own`` stand for (a row), by table look-ups."""
        out = self.squares(x).T.astype(np.float32)[own] + shift[:, None].astype(np.float32)
        for m, (part, book) in enumerate(zip(self.parts_of, self.books, strict=True)):
            table = (-2 * book @ x[:, part].T).astype(np.float32)
            out += table[codes[:, m]]
        return out

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distances from each row to each centroid."""
        return np.maximum((x * x).sum(1)[:, None] + (self.coarse * self.coarse).sum(1) - 2 * x @ self.coarse.T, 0)

    def fill(self, sizes: dict[int, int], radius: dict[int, float]) -> None:
        """Lists, each beside the one nearest to it of those that are left, to bins."""
        self.radius = np.full(len(self.coarse), -np.inf)
        self.first, self.parts = np.zeros(len(self.coarse), np.int64), np.ones(len(self.coarse), np.int64)
        left, at, held, pairs = sorted(sizes), 0, 0, []
        bin_ = 0
        while left:
            far = ((self.coarse[left] - self.coarse[at]) ** 2).sum(1)
            at = left.pop(int(far.argmin()))
            self.radius[at] = radius[at]
            if held and held + sizes[at] > BLOCK:
                bin_, held = bin_ + 1, 0
            held += sizes[at]
            self.first[at], self.parts[at] = bin_, -(-sizes[at] // BLOCK)
            pairs += [(bin_ + k, at) for k in range(self.parts[at])]
            bin_ += int(self.parts[at]) - 1
        #: (bin, list) of every part of a list, by bin.
        self.pairs = np.array(pairs, np.int64)

    def reach(self, x: np.ndarray, own: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
        """Bins (and a column for each: may it hold a vector within ``far`` of the row?)."""
        squares = self.squares(x)
        open_ = np.sqrt(squares) <= far + self.radius + _ROUNDING
        # members of a list are no nearer to the row's own centroid than to theirs
        open_ &= squares - np.take_along_axis(squares, own[:, None], 1) <= 2 * far * np.sqrt(self.squares(self.coarse[own])) + _ROUNDING
        open_[np.arange(len(x)), own] = True
        bins, starts = np.unique(self.pairs[:, 0], return_index=True)
        return bins, np.logical_or.reduceat(open_[:, self.pairs[:, 1]], starts, axis=1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _place(shared: Shared, dim: int):
    def run(batches):
        index = shared.value
        for batch in slices(batches, 1024):
            if not batch.num_rows:
                continue
            x = _unit(_vectors(batch.column(2), dim))
            squares = index.squares(x)
            own = squares.argmin(1)
            codes, shift, error = index.encode(x, own)
            found = [pa.array(own.astype(np.int32)), pa.array(np.sqrt(squares[np.arange(len(own)), own])), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(shift), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *found], ["node", "weight", "v", "list", "radius", "code", "shift", "error"])

    return run


_ROW = ("node", "weight", "v", "list", "code", "shift", "error")


def _visit(shared: Shared, dim: int, far: float):
    """``home`` and all bins to be compared with, for each row of (_ROW, spread)."""

    def run(batches):
        index, n = shared.value, len(_ROW)
        for batch in slices(batches, 1024):
            if not batch.num_rows:
                continue
            own = batch.column(3).to_numpy().astype(np.int64)
            home = index.first[own] + batch.column(n).to_numpy() % index.parts[own]
            bins, open_ = index.reach(_unit(_vectors(batch.column(2), dim)), own, far)
            visits = pa.array([bins[x].astype(np.int32) for x in open_], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(home.astype(np.int32)), visits], [*_ROW, "home", "visits"])

    return run


def _compare(cosine: float, indexes: dict[int, Shared]):
    far = (2 - 2 * cosine) ** 0.5

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, one = key[0].as_py(), key[1].as_py() == key[2].as_py()
        order = np.argsort(table["node"].to_numpy(), kind="stable")
        nodes, weight, side = (table[c].to_numpy()[order] for c in ("node", "weight", "side"))
        x = _unit(_vectors(table["v"].combine_chunks(), dim))[order]
        count, low = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        left = np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        index = indexes[dim].value if dim in indexes else None
        if index:
            own, shift, error = (table[c].to_numpy()[order][right] for c in ("list", "shift", "error"))
            codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(nodes), -1)[order][right]
            most = ((far + error + _SINGLE) ** 2 + _SINGLE)[:, None]
        for at in range(0, len(left) if len(right) else 0, 256):
            some = left[at : at + 256]
            kept = np.flatnonzero((index.distances(x[some], own, codes, shift) <= most).any(axis=1)) if index else np.arange(len(right))
            dots = x[some] @ x[right[kept]].T
            i, j = np.nonzero(dots >= cosine - 1e-9)
            near = np.flatnonzero(dots[i, j] < cosine + 1e-9)
            good = np.ones(len(i), bool)
            i, j = some[i], right[kept[j]]
            # so near the threshold, a sum in an order of its own decides
            for part in range(0, len(near), 1 << 16):
                k = near[part : part + (1 << 16)]
                good[k] = np.einsum("ij,ij->i", x[i[k]], x[j[k]]) >= cosine
            good &= (i < j) if one else True
            i, j = i[good], j[good]
            count += np.bincount(i, weight[j], len(nodes)).astype(np.int64) + np.bincount(j, weight[i], len(nodes)).astype(np.int64)
            join(low, i, j)
        asked, far_ = count > 0, low != np.arange(len(nodes))
        ids = pa.array(np.concatenate([nodes[asked], nodes[far_]]), pa.int64())
        others = pa.concat_arrays([pa.nulls(int(asked.sum()), pa.int64()), pa.array(nodes[low[far_]], pa.int64())])
        return pa.table({"a": ids, "b": others, "n": pa.concat_arrays([pa.array(count[asked], pa.int64()), pa.nulls(int(far_.sum()), pa.int64())])})

    return run


def _cells(classes: DataFrame, dim: int, n: int, cosine: float) -> tuple[DataFrame, Shared]:
    """The ``n`` classes of one length, a row for each cell ``(dim, a, b)`` of bins they are compared in, and their index."""
    share = min(1.0, SAMPLE / n)
    chosen = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = [r["v"] for r in classes.filter(chosen).orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()] or [classes.orderBy("v").first()["v"]]
    spark, kind = classes.sparkSession, dict(classes.dtypes)["v"]
    index = Index(np.array(sample, np.float64), min(LISTS, max(1, int(n**0.5))))
    placed = classes.mapInArrow(_place(Shared(spark, index), dim), f"node bigint, weight bigint, v {kind}, list int, radius double, code binary, shift double, error double")
    placed = written(placed, "placed")
    lists = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()
    index.fill({r["list"]: r["n"] for r in lists}, {r["list"]: r["radius"] for r in lists})
    shared = Shared(spark, index)
    spread = placed.select(*_ROW, F.pmod(F.xxhash64("node"), F.lit(1 << 30)).alias("spread"))
    row = f"node bigint, weight bigint, v {kind}, list int, code binary, shift double, error double"
    visits = spread.mapInArrow(_visit(shared, dim, (2 - 2 * cosine) ** 0.5), f"{row}, home int, visits array<int>")
    visits = visits.select(*_ROW, "home", F.explode("visits").alias("bin"))
    return visits.select(F.lit(dim).alias("dim"), F.least("home", "bin").alias("a"), F.greatest("home", "bin").alias("b"), (F.col("home") > F.col("bin")).cast("int").alias("side"), *_ROW), shared


def near_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """A row for each vector: ``_key, doc_id (the vector's id), n_links, component_id, kept``."""
    rows, by_id = keyed(table, vec_id, vector)
    rows = rows.withColumnRenamed(vector, "v")
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.filter(sound)
    classes = written(usable.groupBy("v").agg(F.min("_key").alias("node"), F.count("*").alias("weight")).select("node", "weight", "v", F.size("v").alias("dim")), "classes")
    indexed = classes.groupBy("dim").count().filter(F.col("count") >= FEW).collect()
    cells = classes.filter(~F.col("dim").isin([r["dim"] for r in indexed])).select("dim", *[F.lit(0).alias(c) for c in ("a", "b", "side")], "node", "weight", "v")
    indexes = {}
    for r in indexed:
        of_length, indexes[r["dim"]] = _cells(classes.filter(F.col("dim") == r["dim"]).drop("dim"), r["dim"], r["count"], cosine)
        cells = cells.unionByName(of_length, allowMissingColumns=True)
    compared = written(cells.groupBy("dim", "a", "b").applyInArrow(_compare(cosine, indexes), "a bigint, b bigint, n bigint"), "compared")
    counted = compared.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    found = components(compared.filter("b is not null").select("a", "b"))
    of = usable.join(classes, "v").select("_key", "node", "weight").join(counted, "node", "left").join(found, "node", "left")
    of = of.select("_key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.select("_key", "doc_id").join(of, "_key", "left").withColumns({"n_links": F.coalesce("n_links", F.lit(0).cast("long")), "component": F.coalesce("component", "_key")})
    if by_id:
        named = out.withColumn("component_id", F.col("component").cast(dict(rows.dtypes)["doc_id"]))
        return named.select("_key", "doc_id", "n_links", "component_id", (F.col("_key") == F.col("component")).alias("kept"))
    names = out.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("first"))
    return out.join(names, "component").select("_key", "doc_id", "n_links", "component_id", (F.col("_key") == F.col("first")).alias("kept"))
