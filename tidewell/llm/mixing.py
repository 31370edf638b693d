"""Mixing sources to target weights by iterative proportional fitting (native).

The documents are first summed to cells (source, language, topic): one partially
aggregated pass, in which a hot source costs one row a task. The cells are written
once and raked: each step scales one margin of the cells to its target tokens. Up to ``FEW`` cells (counted
first) a margin's sums are windows, and a round is one job; beyond, they are partial aggregates of the cells and an
equi-join back, a job a step, so no task holds all cells of a value; both give the same result. A document is then
kept with the probability of its cell, by a hash of its id, so a re-run keeps the same documents.

Targets are shares of tokens a value, a table ``(value, share)`` for each margin.
Without a table they are tempered: the shares in the data to the power
``temper``, scaled to one, which lifts rare values and lowers frequent ones.

Defined results: null values of a margin form a value of their own (``\\N``); a null or
empty text has no tokens and its cell's probability (1 where the cell has none); an
empty table stays empty; repeated rows with one id share their fate; a null id draws as the
text ``\\N``. Only named columns are read for the cells; all columns of the input are returned,
whatever their names, but one that is named as the probability gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Words of the texts stand for tokens.
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 8
TEMPER = 0.8
#: Cells that one task may hold.
FEW = 50_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic, for tables without one: what kind of page the text looks like."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("icensed under"), "licensed")
        .when(text.contains("@"), "contact")
        .when(F.length(text) < 800, "short")
        .otherwise("prose")
    )


def cells(docs: DataFrame, margins: dict[str, Column], tokens: Column) -> DataFrame:
    keys = [F.coalesce(c.cast("string"), F.lit("\\N")).alias(f"_m{i}") for i, c in enumerate(margins.values())]
    return docs.select(*keys, tokens.alias("_n")).groupBy(*[f"_m{i}" for i in range(len(margins))]).agg(F.sum("_n").cast("double").alias("_n"))


def tempered(cell: DataFrame, column: str, temper: float) -> DataFrame:
    """(value, share): the shares of a margin to the power ``temper``, scaled to sum to one."""
    sums = cell.groupBy(column).agg(F.sum("_n").alias("n")).filter("n > 0").withColumn("n", F.pow("n", F.lit(temper)))
    whole = sums.agg(F.sum("n")).first()[0] or 1.0
    return sums.select(F.col(column).alias("value"), (F.col("n") / F.lit(whole)).alias("share"))


def rake(docs: DataFrame, margins: dict[str, Column], tokens: Column, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, rate: float | None = None, kept: float | None = None, tolerance: float | None = None, few: int = FEW) -> DataFrame:
    """Cells with ``_n`` (tokens), ``_w`` (raked tokens), ``_p`` (probability of keeping a document) and ``_off`` (the largest residual of all).

    Probabilities are the ratios ``_w / _n`` times ``rate``, 1 at most; by default the
    rate is the largest that needs no such limit, so the kept tokens meet the targets.
    With ``kept``, this share of all tokens is kept instead: what is too rare for its target is
    kept whole, and the rest is raked on, so that no rare cell decides how much of the others goes.
    With ``tolerance``, rounds end once no value's share is further from its target; ``residuals`` reports how far they are.
    """
    names = [f"_m{i}" for i in range(len(margins))]
    start = written(cells(docs, margins, tokens), "cells")
    whole = start.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("cells")).first()
    total, small = whole["n"] or 0.0, whole["cells"] <= few
    goals = {}
    for name, margin in zip(names, margins, strict=True):
        given = (targets or {}).get(margin)
        shares = tempered(start, name, temper) if given is None else given.select(F.col("value").cast("string"), F.col("share").cast("double"))
        goals[name] = written(shares.select("value", (F.col("share") * F.lit(total)).alias("goal")) if kept is None else _goals(start, name, shares, total * kept), "goals")
    fitted = start.withColumn("_w", F.col("_n") * F.lit(1.0 if kept is None else float(kept)))
    for _ in range(rounds):
        for name, goal in goals.items():
            fitted = _step(fitted, names, name, goal, small, kept is not None)
        # written: where a step joins, the cells stand twice in its plan, which would double with every step
        fitted = written(fitted, "fitted") if small else fitted
        if tolerance is not None and _furthest(fitted, goals) <= tolerance:
            break
    ratio = F.when(F.col("_n") > 0, F.col("_w") / F.col("_n"))
    scale = 1.0
    if kept is None:
        scale = 1.0 / (fitted.agg(F.max(ratio)).first()[0] or 1.0) if rate is None else rate
    return fitted.withColumns({"_p": F.coalesce(F.least(F.lit(1.0), ratio * F.lit(scale)), F.lit(1.0)), "_off": F.lit(_furthest(fitted, goals))})


def _step(fitted: DataFrame, names: list[str], name: str, goal: DataFrame, small: bool, bounded: bool) -> DataFrame:
    """The cells with one margin raked to its goals; ``bounded``: no cell beyond what it has."""
    full = (F.col("_w") >= F.col("_n")) & F.lit(bounded)
    s, f = F.sum("_w"), F.sum(F.when(full, F.col("_w")).otherwise(0.0))
    if small:
        of = Window.partitionBy(name)
        sums = fitted.withColumns({"_s": s.over(of), "_f": f.over(of)})
    else:
        sums = fitted.join(fitted.groupBy(name).agg(s.alias("_s"), f.alias("_f")), name)
    sums = sums.join(goal.select(F.col("value").alias(name), F.col("goal").alias("_g")), name, "left").withColumn("_g", F.coalesce("_g", F.lit(0.0)))
    raked = F.when(F.col("_s") > 0, F.col("_w") * F.col("_g") / F.col("_s")).otherwise(0.0)
    if bounded:
        # cells that are kept whole cannot take more, so the others do
        more = F.when(full, F.col("_n")).otherwise(F.least(F.col("_n"), F.coalesce(F.try_divide(F.col("_w") * (F.col("_g") - F.col("_f")), F.col("_s") - F.col("_f")), F.lit(0.0))))
        raked = F.when((F.col("_g") > F.col("_s")) & (F.col("_s") > 0), more).otherwise(raked)
    out = sums.withColumn("_w", raked).select(*names, "_n", "_w")
    return out if small else written(out, "fitted")


def _furthest(fitted: DataFrame, goals: dict[str, DataFrame]) -> float:
    shares = {name: goal.select("value", F.coalesce(F.try_divide("goal", F.sum("goal").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)).alias("share")) for name, goal in goals.items()}
    return residuals(fitted, shares).agg(F.max("off")).first()[0] or 0.0


def residuals(fitted: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(margin, value, share, got, off): each value's target and raked share of tokens, and how far they lie apart."""
    total, found = F.lit(fitted.agg(F.sum("_w")).first()[0] or 1.0), None
    for name, target in targets.items():
        sums = fitted.groupBy(F.col(name).alias("value")).agg((F.sum("_w") / total).alias("got"))
        one = sums.join(target.select("value", "share"), "value", "full_outer").select(F.lit(name).alias("margin"), "value", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("got", F.lit(0.0)).alias("got"))
        found = one if found is None else found.unionByName(one)
    return found.withColumn("off", F.abs(F.col("share") - F.col("got")))


def _goals(start: DataFrame, name: str, shares: DataFrame, budget: float) -> DataFrame:
    """(value, goal): tokens in proportion to the shares, but no more of a value than there are, ``budget`` in all where there are enough."""
    sums = start.groupBy(name).agg(F.sum("_n").alias("have")).join(shares, F.col(name) == F.col("value"), "left")
    sums = written(sums.select(F.col(name).alias("value"), "have", F.coalesce("share", F.lit(0.0)).alias("share")), "goals")
    level = 0.0
    while True:
        full = F.col("share") * F.lit(level) >= F.col("have")
        found = sums.agg(F.sum(F.when(full, F.col("have"))).alias("have"), F.sum(F.when(~full, F.col("share"))).alias("share")).first()
        if not found["share"]:
            break
        more = (budget - (found["have"] or 0.0)) / found["share"]
        if more <= level * (1 + 1e-12):
            break
        level = more
    return sums.select("value", F.least("have", F.col("share") * F.lit(level)).alias("goal"))


def draw(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("\\N")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, margins: dict[str, Column], tokens: Column, key: str = "doc_id", seed: int = 0, probability: str | None = None, residual: str | None = None, **fit) -> DataFrame:
    """The documents kept, with all their columns (and, where names for them are given, their probability and the largest residual)."""
    fitted = rake(docs, margins, tokens, **fit)
    names = [f"_m{i}" for i in range(len(margins))]
    cell = [F.coalesce(c.cast("string"), F.lit("\\N")).alias(n) for n, c in zip(names, margins.values(), strict=True)]
    # the rows travel as one column, so that theirs may have any names
    placed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), draw(F.col(key), seed).alias("_u"), *cell)
    kept = placed.join(fitted.select(*names, "_p", "_off"), names).filter("_u < _p")
    more = {name: c for name, c in ((probability, "_p"), (residual, "_off")) if name}
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in more], *[F.col(c).alias(name) for name, c in more.items()])
