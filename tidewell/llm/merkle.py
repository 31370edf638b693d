"""A Merkle manifest of a dataset, level by level.

Rows are leaves. Per group (a source) the leaves ascend by their order; every run of ``fanout``
consecutive nodes becomes their hash until one node, the subroot, is left; subroots ordered by group
give the root in the same way. A level is one ``groupBy`` on (group, index divided by the fanout): no
task sees more of a group than its runs, so a group of a third of all rows is as even as any other.

Indices are row numbers without a task that holds a group: rows are dealt by range of (group,
order), numbered inside a (group, range), and what earlier ranges of the group hold is added. On the way
down each level appends a node's siblings to the path of its parent, so paths exist once a run, not once
a row, until the last projection hashes and drops them. Only hashes move; texts never leave their scan.

Defined results: null fields are hashed as ``-``; a null group is a group of its own, before all
others; null and repeated ids are leaves as any, equal ids ordered by their leaf; a group of
one row has its leaf as subroot, a dataset of one group has its subroot as root; an empty table has no
rows; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A field of a leaf: ``-`` for NULL, else its length in UTF-8 bytes, a colon and the value; no two rows concatenate alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return digest(*[encoded(f) for f in fields])


def numbered(rows: DataFrame, group: str, order: Sequence[str], index: str = "i", size: str = "n") -> DataFrame:
    """``rows`` with their index (from 0) in ``group`` by ``order``, and the group's size."""
    # written before they are dealt: ranges are found by a pass of their own, which would hash every leaf again
    dealt = written(written(rows, "leaves").repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_held"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    places = held.select(group, "_range", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"), F.sum("_held").over(whole).alias(size))
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(places, [group, "_range"]).withColumn(index, F.col("_before") + F.col("_place") - 1).drop("_range", "_place", "_before", "_held")


class Tree:
    """Runs of all levels of one hash tree for each group, as written tables.

    ``runs[k]`` has a row for each run of level k: group, i (of the run, and of its parent node), kids
    (nodes of the run in order, with the payload at level 0), h (the parent's hash) and n (nodes of the next level).
    """

    def __init__(self, rows: DataFrame, group: str, order: Sequence[str], h: str, payload: Sequence[str] = (), fanout: int = FANOUT):
        self.group, self.fanout = group, fanout
        nodes = numbered(rows, group, order).withColumnRenamed(h, "h")
        self.runs = [written(self._runs(nodes, payload), "runs")]
        most = self.runs[0].agg(F.max("n")).first()[0] or 0
        while most > 1:
            above = self.runs[-1].filter("n > 1").select(group, "i", "h", "n")
            self.runs.append(written(self._runs(above, ()), "runs"))
            most = -(-most // fanout)

    def _runs(self, nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
        kid = F.struct("i", "h", *payload)
        runs = nodes.groupBy(self.group, F.floor(F.col("i") / self.fanout).alias("run")).agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.first("n").alias("n"))
        own = F.sha2(F.array_join(F.transform("kids", lambda k: k["h"]), ""), 256)
        h = F.when(F.col("n") == 1, F.col("kids")[0]["h"]).otherwise(own)  # the only node of a group is not hashed again
        return runs.select(self.group, F.col("run").alias("i"), "kids", h.alias("h"), F.ceil(F.col("n") / self.fanout).alias("n"))

    def tops(self) -> DataFrame:
        """(group, h): the last node of each group."""
        tops = [runs.filter("n = 1").select(self.group, "h") for runs in self.runs]
        out = tops[0]
        for t in tops[1:]:
            out = out.unionByName(t)
        return out

    def leaves(self, above: DataFrame) -> DataFrame:
        """A row for each leaf: group, kid, ``path`` and the columns of ``above``, which has a row for each group with the path over its last node.

        A path is the siblings before and after a node, its own level first.
        """
        kept = [c for c in above.columns if c not in (self.group, "path")]
        nodes = None
        for runs in reversed(self.runs[1:]):
            nodes = written(self._kids(runs, self._tops_with(runs, above, nodes), kept).select(self.group, F.col("kid.i").alias("i"), "path", *kept), "paths")
        return self._kids(self.runs[0], self._tops_with(self.runs[0], above, nodes), kept)

    def _tops_with(self, runs: DataFrame, above: DataFrame, nodes: DataFrame | None) -> DataFrame:
        """The parents of these runs: last nodes of their groups, and nodes that the level above has placed."""
        tops = runs.filter("n = 1").select(self.group, "i").join(above, self.group).select(self.group, "i", *[c for c in above.columns if c != self.group])
        return tops if nodes is None else tops.unionByName(nodes)

    def _kids(self, runs: DataFrame, parents: DataFrame, kept: list[str]) -> DataFrame:
        runs = runs.select(self.group, "i", "kids")
        one = runs.join(parents, [self.group, "i"]).withColumn("_hashes", F.transform("kids", lambda k: k["h"]))
        only = (F.col("i") == 0) & (F.size("kids") == 1)
        one = one.select(self.group, "path", "_hashes", only.alias("_only"), *kept, F.posexplode("kids").alias("_at", "kid"))
        before = F.array_join(F.slice("_hashes", F.lit(1), F.col("_at")), "")
        after = F.array_join(F.slice("_hashes", F.col("_at") + 2, F.size("_hashes")), "")
        step = F.when(F.col("_only"), F.array().cast(_STEP)).otherwise(F.array(F.struct(before.alias("before"), after.alias("after"))))
        return one.select(self.group, "kid", F.concat(step, F.col("path")).alias("path"), *kept)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, tampered: dict[str, Column] | None = None, where: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``tampered`` replaces fields of rows that ``where`` names before the root is folded; without it every row verifies.
    """
    changed = {**{f: F.col(f) for f in fields}, **(tampered or {})}
    other = F.when(F.lit(False) if where is None else where, leaf_of([changed[f] for f in fields]))
    # null sorts before all groups, and is equal to itself
    name = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = rows.select(name.alias("_group"), F.col(key).alias("_key"), leaf_of([F.col(f) for f in fields]).alias("_leaf"), other.alias("_other"))
    groups = Tree(leaves, "_group", ["_key", "_leaf", "_other"], "_leaf", ["_key", "_other"], fanout)
    tops = Tree(groups.tops().select(F.lit(0).alias("_all"), "_group", "h"), "_all", ["_group"], "h", ["_group"], fanout)
    root = tops.tops().select("_all", F.col("h").alias("root"), F.array().cast(_STEP).alias("path"))
    above = tops.leaves(root).select(F.col("kid._group").alias("_group"), F.col("kid.h").alias("subroot"), "root", "path")
    found = groups.leaves(written(above, "subroots")).select(F.col("kid.*"), "subroot", "root", "path")
    checked = found.select(F.col("_key").alias(key), F.col("h").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("_other", "h"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
