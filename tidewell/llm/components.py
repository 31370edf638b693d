"""Connected components of a link table by alternating star contraction.

Links are thinned first: each task keeps a forest of its share, every node linked to the
smallest one its share connects it with, so a dense group sends a link for a node, not
for a pair. Both halves of a round are a partially aggregated minimum per node and an
equi-join back, so a node with a third of all links is combined map-side and its
join is one that adaptive execution can split. Each round is written to the
shared folder. Links of all documents never reach the driver: only two counters do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, scope, written


def join(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of each i and j; ``low`` holds the smallest place in each place's component."""
    while True:
        a, b = low[i], low[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(low, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (low[low] != low).any():
            low[:] = low[low]


#: Links that a task holds beside its forest before it thins them.
_HELD = 1 << 18


def _thinned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = np.arange(len(nodes))
    join(low, at[: len(a)], at[len(a) :])
    far = low != np.arange(len(nodes))
    return nodes[low[far]], nodes[far]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left, right, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for batch in batches:
        left.append(batch.column(0).to_numpy())
        right.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= _HELD:
            a, b = _thinned(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0
    a, b = _thinned(np.concatenate(left), np.concatenate(right))
    for at in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], ["a", "b"])


def _star(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v): link every v of u to the smallest node around u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return pairs.join(least, "u")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``: the smallest node reachable. Only linked nodes appear."""
    with scope() as made:
        edges = written(
            links.filter("a is not null and b is not null and a != b")
            .select(F.col("a").cast("long"), F.col("b").cast("long"))
            .mapInArrow(_forest, "a bigint, b bigint")
            .distinct(),
            "links",
        )
        last = None
        for _ in range(rounds):
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
            large = _star(both).filter("v > u").select(F.col("low").alias("a"), F.col("v").alias("b")).filter("a != b").distinct()
            down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
            small = _star(down)
            small = small.select(F.col("low").alias("a"), F.col("v").alias("b")).unionByName(small.select(F.col("low").alias("a"), F.col("u").alias("b")))
            done = made[:]
            edges = written(small.filter("a != b").distinct(), "star")
            seen = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("decimal(20,0)")).alias("s"), F.countDistinct("b").alias("d")).first()
            made[:] = made[len(done) :]
            forget(links.sparkSession, done)
            if tuple(seen) == last and seen["n"] == seen["d"]:
                break
            last = tuple(seen)
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
